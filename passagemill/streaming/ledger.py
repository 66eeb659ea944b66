"""Which contents a corpus has taken up: hashes in buckets, a filter for each, one commit per batch.

The ledger of a table lies beside it.  ``hashes`` holds (path, doc_sha) of each batch in the
order of hashes, with a bucket, the hash's first hexadecimal digits; ``filters`` holds a bitmap
for each bucket of a batch, in which every hash sets a bit; ``commits`` names the batches that
were written to their end.  A batch reads the filters of its own buckets, and hashes only of
buckets in which a filter may know one of its contents: the files are sorted, so Parquet
skips the others' row groups.

Everything is written under the batch's own id and replaces what an earlier try of the same
batch left, and a batch never counts its own hashes as known: running it again gives the same
tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BITS = 32_768  # of Spark's bitmap aggregate


@dataclass(frozen=True)
class Ledger:
    path: str
    digits: int = 2

    def _read(self, spark: SparkSession, name: str, schema: str, buckets: list[str] | None = None) -> DataFrame:
        """A table of the ledger; one that is not there yet is empty."""
        try:
            rows = spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def bucket(self, sha: Column) -> Column:
        return F.concat(F.lit("b"), F.substring(sha, 1, self.digits))

    def hashes(self, spark: SparkSession, buckets: list[str] | None = None) -> DataFrame:
        return self._read(spark, "hashes", "path string, doc_sha string, bucket string, batch string", buckets)

    def commits(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "commits", "n_files long, batch string")

    def known(self, keys: DataFrame, batch: str) -> DataFrame:
        """``doc_sha`` of those ``keys(doc_sha)`` that another batch has taken up."""
        spark = keys.sparkSession
        marked = keys.select("doc_sha", self.bucket(F.col("doc_sha")).alias("bucket"), _bit(F.col("doc_sha")).alias("bit")).distinct()
        asked = [r["bucket"] for r in marked.select("bucket").distinct().collect()]  # 16 ** digits at most
        filters = self._read(spark, "filters", "bitmap binary, bucket string, batch string", asked).where(F.col("batch") != batch)
        filters = filters.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        maybe = marked.join(filters, "bucket").where(_is_set(byte, F.col("bit")))
        maybe = maybe.select("doc_sha", "bucket")
        where = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
        if not where:
            return spark.createDataFrame([], "doc_sha string")
        others = self.hashes(spark, where).where(F.col("batch") != batch).select("bucket", "doc_sha")
        return maybe.join(others, ["bucket", "doc_sha"], "left_semi").select("doc_sha")

    def commit(self, fresh: DataFrame, batch: str) -> None:
        """Take up ``fresh(path, doc_sha)`` under the batch; the commit itself comes last."""
        spark = fresh.sparkSession
        rows = fresh.select("path", "doc_sha", self.bucket(F.col("doc_sha")).alias("bucket"), F.lit(batch).alias("batch"))
        _replace(rows.repartitionByRange("doc_sha").sortWithinPartitions("doc_sha"), f"{self.path}/hashes")
        own = self.hashes(spark).where(F.col("batch") == batch)
        bits = own.select("bucket", "batch", _bit(F.col("doc_sha")).alias("bit"))
        filters = bits.groupBy("bucket", "batch").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        _replace(filters.select("bitmap", "bucket", "batch"), f"{self.path}/filters")
        _replace(own.agg(F.count("*").alias("n_files")).withColumn("batch", F.lit(batch)), f"{self.path}/commits")


def _bit(sha: Column) -> Column:
    return F.bitmap_bit_position(F.pmod(F.xxhash64(sha), F.lit(BITS)) + 1)


def _is_set(byte: Column, bit: Column) -> Column:
    return F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1


def _replace(rows: DataFrame, target: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)
