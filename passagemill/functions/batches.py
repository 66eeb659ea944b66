"""How much of a table a Python worker holds at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Spark counts rows, 10,000 of them: of whole texts that is many times their size as Python objects.
LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, so that a worker's memory does not grow with its task; what the session sets itself stays."""
    for key, limit in LIMITS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, limit)
