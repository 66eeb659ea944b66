"""Incremental ingestion of new documents."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from passagemill.operators.identity import first_copies
from passagemill.sources.sinks import scratch_dir
from passagemill.streaming.ledger import Ledger


def ledger_of(target: str) -> Ledger:
    """The ledger of a table lies beside it."""
    return Ledger(f"{target.rstrip('/')}_ledger")


def _adopt(spark: SparkSession, target: str, ledger: Ledger) -> None:
    """A table that has no ledger yet gives its contents to a new one; without ``doc_sha`` it cannot."""
    if not ledger.commits(spark).isEmpty():
        return
    try:
        rows = spark.read.parquet(target)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return
        raise
    if "batch" not in rows.columns:  # else a first batch broke off, and runs again
        ledger.commit(rows.select("doc_sha").distinct().select(F.lit(None).cast("string").alias("path"), "doc_sha"), "before")


def append_new(
    files: DataFrame,
    target: str,
    build: Callable[[DataFrame], DataFrame] = lambda df: df,
    batch: str | None = None,
) -> None:
    """Append what ``build`` makes of the files whose content is new to the table.

    ``files(path, doc_sha, ...)``.  Copies and known contents are settled on staged paths and
    hashes; then the new files are read.  Rows are written under the batch's id, the
    ledger takes its hashes up afterwards.  A batch that runs again, under the same id and
    with the same files, replaces its rows by the same ones.
    """
    spark, ledger = files.sparkSession, ledger_of(target)
    batch = batch or f"run-{uuid.uuid4().hex}"
    _adopt(spark, target, ledger)
    noted = scratch_dir(spark, "batch-keys")
    files.select("path", "doc_sha").write.parquet(noted)
    keys = spark.read.schema("path string, doc_sha string").parquet(noted)
    first = keys.join(first_copies(keys), "path", "left_semi")
    fresh_at = scratch_dir(spark, "fresh")
    first.join(ledger.known(keys, batch), "doc_sha", "left_anti").select("path", "doc_sha").write.parquet(fresh_at)
    fresh = spark.read.schema("path string, doc_sha string").parquet(fresh_at)
    made = build(files.join(fresh.select("path"), "path", "left_semi")).withColumn("batch", F.lit(batch))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)
    ledger.commit(fresh, batch)


def read_committed(spark: SparkSession, target: str) -> DataFrame:
    """The table without rows of a batch that broke off; rows from before it had a ledger count."""
    found = spark.read.parquet(target).schema
    if "batch" not in found.names:
        return spark.read.schema(found).parquet(target)
    columns = [T.StructField("batch", T.StringType()) if f.name == "batch" else f for f in found.fields]
    rows = spark.read.schema(T.StructType(columns)).parquet(target)  # names of batches are no numbers
    done = ledger_of(target).commits(spark).select("batch").distinct()
    return rows.where(F.col("batch").isNull()).unionByName(rows.join(done, "batch", "left_semi").select(*rows.columns))


def batch_name(checkpoint: str, number: int) -> str:
    """The id under which a stream's micro-batch is committed; another stream has other ids."""
    return f"{hashlib.sha1(checkpoint.rstrip('/').encode()).hexdigest()[:12]}-{number:012d}"


def ingest_stream(
    stream: DataFrame, target: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] = lambda df: df
) -> None:
    """Run ``append_new`` on every micro-batch until the source has no more files."""

    def on_batch(batch: DataFrame, number: int) -> None:
        append_new(batch, target, build, batch_name(checkpoint, number))

    query = (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
