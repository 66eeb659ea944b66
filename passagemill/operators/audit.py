"""Run statistics, per-file records, samples and the run manifest."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import paths
from passagemill.functions.text import garbage_fraction
from passagemill.sources import sinks


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunk count, least, average (whole number) and greatest length, mean garbage."""
    size = F.length("text").cast("long")
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.min(size).alias("chunk_chars_min"),
        F.floor(F.try_divide(F.sum(size), F.count("*"))).cast("long").alias("chunk_chars_avg"),
        F.max(size).alias("chunk_chars_max"),
        F.avg(garbage_fraction(F.col("text"))).alias("avg_garbage_fraction"),
    )


def file_summary(files: DataFrame, chunks: DataFrame, root: str | None = None) -> DataFrame:
    """One record per file: ingested ones with their chunk count, skipped ones with a reason.

    ``files(path, name, category, doc_sha, reason)`` are all files of the run,
    ``reason`` null for the ingested; ``chunks(path)`` are the chunks made of them.  With
    ``root``, paths below it are told relative to it.
    """
    counted = chunks.groupBy("path").agg(F.count("*").alias("chunks"))
    taken = F.col("reason").isNull()
    told = F.col("path") if root is None else paths.relative_path(F.col("path"), root)
    return files.join(counted, "path", "left").select(
        told.alias("path"),
        "name",
        F.when(taken, F.col("category")).alias("category"),
        F.when(taken, F.col("doc_sha")).alias("sha256"),
        F.when(taken, F.coalesce("chunks", F.lit(0))).alias("chunks"),
        "reason",
    )


CELL_PATHS = 10_000  # paths of a cell that is no longer refined but sorted
MORE = 3  # characters by which a cell's prefix grows


@dataclass(frozen=True)
class _Cell:
    """The paths whose keys start with ``prefix``, or the one that it names: the place of the first chunk, and how long the next prefixes are."""

    prefix: str
    start: int
    length: int
    whole: bool = False  # ``prefix`` is a key

    def holds(self, key: Column) -> Column:
        return key == self.prefix if self.whole else key.startswith(self.prefix)


def _refined(counts: DataFrame, cells: list[_Cell], places: list[int]) -> tuple[list[_Cell], int]:
    """The cells within the given ones that hold a wanted place, and the most paths that one of them has."""
    key = F.col("key")
    case = lambda value: reduce(lambda w, c: w.when(c.holds(key), value(c)), cells[1:], F.when(cells[0].holds(key), value(cells[0])))
    fine = counts.select("n", "key", case(lambda c: F.lit(c.start)).alias("parent"), case(lambda c: F.substring(key, 1, c.length)).alias("cell")).where("parent is not null")
    sums = fine.groupBy("parent", "cell").agg(F.sum("n").alias("n"), F.count("*").alias("paths"), F.min("key").alias("low"), F.max("key").alias("high"))
    before = Window.partitionBy("parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("start", F.col("parent") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = F.array(*[F.lit(p).cast("long") for p in places])
    hit = placed.where(F.exists(wanted, lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n")))).collect()  # one for each place at most
    found = [_Cell(r["cell"], r["start"], len(os.path.commonprefix([r["low"], r["high"]])) + MORE, r["low"] == r["high"] == r["cell"]) for r in hit]
    return found, max((r["paths"] for r in hit), default=0)


def sample_chunks(chunks: DataFrame, sample: int = 3, cell_paths: int = CELL_PATHS) -> DataFrame:
    """Chunks at a fixed stride over the whole corpus in path order, ``sample`` of them.

    ``chunks`` holds ``path, chunk_index`` (numbered from 0 within a path).  Nothing is sorted
    as a whole: chunks are counted per path, the counts are summed by prefixes of the paths'
    keys, and only the cells that hold a wanted place are summed again by longer prefixes,
    until one has at most ``cell_paths`` paths.  Those are sorted, a cell in a task.
    """
    spark = chunks.sparkSession
    at = sinks.scratch_dir(spark, "path-counts")
    chunks.groupBy("path").agg(F.count("*").alias("n")).withColumn("key", paths.sort_key(F.col("path"))).write.parquet(at)
    counts = spark.read.parquet(at)
    total = counts.agg(F.sum("n")).first()[0] or 0
    step = max(1, total // max(1, sample))
    places = [k * step for k in range(sample) if k * step < total]
    if not places:
        return chunks.withColumn("place", F.lit(None).cast("long")).limit(0)
    cells, most = _refined(counts, [_Cell("", 0, 0)], places)
    while most > cell_paths:
        cells, most = _refined(counts, cells, places)
    own = F.coalesce(*[F.when(c.holds(F.col("key")), F.lit(c.start)) for c in cells])
    in_cell = Window.partitionBy("start").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("n").over(in_cell), F.lit(0))
    inside = F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("n")))
    wanted = (
        counts.withColumn("start", own)
        .where("start is not null")
        .withColumn("first", first)
        .select("path", "first", F.explode(inside).alias("place"))
        .select("path", (F.col("place") - F.col("first")).cast("int").alias("chunk_index"), "place")
    )
    # At most ``sample`` rows, so this side is small by construction.
    return chunks.join(F.broadcast(wanted), ["path", "chunk_index"])


def _literal(value: object) -> Column:
    if isinstance(value, dict):
        return F.struct(*[_literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[_literal(v) for v in value])
    return F.lit(value)


def manifest_records(summary: DataFrame, stats: DataFrame, run: dict[str, object]) -> DataFrame:
    """The run's audit record as JSON lines ``(kind, path, record)``.

    One ``run`` row with source, target, chunking and totals, one ``file`` row per
    ingested and one ``skipped`` row per skipped file, so the record of a corpus of
    any size is written in parallel.
    """
    done = F.col("reason").isNull()
    files = summary.agg(
        F.count("*").alias("files_discovered"),
        F.coalesce(F.sum(done.cast("long")), F.lit(0)).alias("files_ingested"),
        F.coalesce(F.sum((~done).cast("long")), F.lit(0)).alias("files_skipped"),
    )
    # Two one-row aggregates side by side.
    totals = files.withColumn("_one", F.lit(1)).join(stats.withColumn("_one", F.lit(1)), "_one").drop("_one")
    fixed = [_literal(value).alias(name) for name, value in run.items()]
    head = totals.select(
        F.lit("run").alias("kind"),
        F.lit("").alias("path"),
        F.to_json(F.struct(*fixed, F.struct(*[F.col(c) for c in totals.columns]).alias("totals"))).alias("record"),
    )
    file_rows = summary.where(done).select(
        F.lit("file").alias("kind"),
        "path",
        F.to_json(F.struct("category", "chunks", "name", "path", "sha256")).alias("record"),
    )
    skipped = summary.where(~done).select(
        F.lit("skipped").alias("kind"), "path", F.to_json(F.struct("name", "path", "reason")).alias("record")
    )
    return head.unionByName(file_rows).unionByName(skipped)
