"""Content identity and exact-copy removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import paths
from passagemill.functions.text import DUPLICATE


def content_sha(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def first_copies(files: DataFrame, path: str = "path", sha: str = "doc_sha") -> DataFrame:
    """The first path of every content.

    The minimum is combined before the shuffle, so a content with very many copies
    sends one row per task, not one per copy.  Only paths and hashes take part.
    """
    key = F.min(F.struct(paths.sort_key(F.col(path)).alias("k"), F.col(path).alias("p")))
    return files.groupBy(sha).agg(key.alias("first")).select(F.col("first.p").alias(path))


def split_copies(
    files: DataFrame, path: str = "path", sha: str = "doc_sha", keys: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(kept, copies)``: the first file of each content in path order, and the rest.

    The copies are settled on paths and hashes alone; then only their paths, usually few,
    meet the files.  Adaptive execution broadcasts them where their measured size allows,
    and texts are not shuffled.  Joins are on the path, which is unique: no task sees all
    copies of a content.

    ``keys`` are the files' paths and hashes where they are written already, with what else
    the copies should have; without them every use of the result hashes the files again.
    """
    told = files if keys is None else keys
    again = told.select(path).join(first_copies(told, path, sha), path, "left_anti")
    kept = files.join(again, path, "left_anti")
    copies = told.join(again, path, "left_semi").withColumn("reason", F.lit(DUPLICATE))
    return kept, copies
