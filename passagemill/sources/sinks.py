"""Writing chunk tables and audit records."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="passagemill-")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session may do without that setting: on a cluster each executor would
    write to a disk that the others do not see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_chunks(chunks: DataFrame, target: str, drop_old: bool = False) -> None:
    """Replace or extend a chunk table, partitioned by file suffix."""
    mode = "overwrite" if drop_old else "append"
    chunks.write.mode(mode).partitionBy("source_ext").parquet(target)


def replace_partitions(chunks: DataFrame, target: str) -> None:
    """Replace only the suffix partitions that ``chunks`` has rows for."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_ext").parquet(target)


def delete_where(collection: DataFrame, predicate: Column) -> DataFrame:
    """Rows that stay after deleting by a metadata predicate; a null answer deletes nothing."""
    return collection.where(~predicate | predicate.isNull())


def rewrite_without(spark: SparkSession, source: str, target: str, predicate: Column) -> None:
    """Write the table without the deleted rows to a new place; the old one stays readable meanwhile."""
    delete_where(spark.read.parquet(source), predicate).write.mode("errorifexists").partitionBy(
        "source_ext"
    ).parquet(target)


def delete_in_place(spark: SparkSession, target: str, predicate: Column) -> list[str]:
    """Delete rows of a chunk table by rewriting only the files that hold any; returns the suffixes that lost rows.

    Files without such rows keep their name and time.  What stays of the others is staged, so
    the table is never read while it is written, then added in new files, and only then the
    old files go: a run that breaks off in between leaves rows twice, never fewer, and may
    run again.  A partition that loses all rows goes.  Names of files and suffixes are on the
    driver, as they are whenever the table is read.
    """
    table = spark.read.parquet(target)
    hit = table.where(predicate).select("source_ext", F.col("_metadata.file_path").alias("file")).distinct().collect()
    if not hit:
        return []
    files = sorted({r["file"] for r in hit})
    staged = scratch_dir(spark, "kept")
    old = spark.read.schema(table.schema).option("basePath", target).parquet(*files)
    delete_where(old, predicate).write.parquet(staged)
    spark.read.schema(table.schema).parquet(staged).write.mode("append").partitionBy("source_ext").parquet(target)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for name in files:
        path = hadoop(name)
        store, folder = path.getFileSystem(conf), path.getParent()
        store.delete(path, False)
        if not any(not x.getPath().getName().startswith((".", "_")) for x in store.listStatus(folder)):
            store.delete(folder, True)
    return sorted({r["source_ext"] for r in hit})


def write_manifest(records: DataFrame, target: str) -> None:
    """Audit record as JSON lines, one folder per kind of record."""
    records.select("kind", "record").write.mode("errorifexists").partitionBy("kind").text(target)
