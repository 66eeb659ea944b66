"""Meeting two vector tables part by part: held vectors stay in a task, asked ones stream past.

A part is a bounded share of the held table.  Both tables are shuffled once by part; in a
task the held rows of a part come first and are kept as one matrix, then the asked rows of
that part are read one block after another.  Neither table reaches the driver and the number
of blocks does not change the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_VALUES = 1 << 22  # numbers of one part's matrix, so 32 MB in double precision
STEP_VALUES = 1 << 20  # numbers of a matrix that a step works on, so 8 MB
TIE_DECIMALS = 12
TASKS, GROUP_ROWS = 96, 4_096  # tasks that all pairs are dealt to at least; rows below which a group is not worth a copy of the part
MERGE = 64  # lists of the best that meet in one step

Work = Callable[[int, list[pa.RecordBatch], pa.RecordBatch], Iterator[pa.RecordBatch]]


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size as rows of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def part_rows(dim: int) -> int:
    """How many vectors of a size make up one part."""
    return max(1, PART_VALUES // max(1, dim))


def query_groups(rows: int, parts: int) -> int:
    """Into how many groups the queries are dealt, so that few parts still make ``TASKS`` tasks; a small table has one."""
    return max(1, min(-(-TASKS // parts), -(-rows // GROUP_ROWS)))


def dealt(vectors: DataFrame, key: str, parts: int) -> Column:
    """The part of each row when a table is spread evenly over ``parts``."""
    return F.pmod(F.xxhash64(vectors[key]), F.lit(parts))


def meet(held: DataFrame, asked: DataFrame, work: Work, schema: str, count: int | None = None) -> DataFrame:
    """``work(part, held rows, asked rows)`` for every block of asked rows in every part that both have.

    Both tables have ``part`` first and then the same columns.  With the ``count`` of parts, they are
    dealt to so many tasks: adaptive execution goes by bytes and would put small parts with much work together.
    """
    names = held.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept = None, []
        for batch in batches:
            marks = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            borders = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for a, b in zip(borders, borders[1:]):
                if a == b:
                    continue
                now, kind = marks[a].tolist()
                if now != part:
                    part, kept = now, []
                rows = batch.slice(a, b - a).select(names)
                if kind == 0:
                    kept.append(rows)
                elif kept:
                    kept = [pa.Table.from_batches(kept).combine_chunks().to_batches()[0]] if len(kept) > 1 else kept
                    yield from work(part, kept[0], rows)

    def side(table: DataFrame, kind: int) -> DataFrame:
        return table.select(F.col("part").cast("long").alias("part"), F.lit(kind).cast("long").alias("kind"), *names)

    rows = side(held, 0).unionByName(side(asked, 1))
    spread = rows.repartition("part") if count is None else rows.repartition(min(2 * count, 4_096), "part")
    return spread.sortWithinPartitions("part", "kind").mapInArrow(run, schema)


def rank_in(rows: DataFrame, k: int, *by: Column | str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.round("score", TIE_DECIMALS).desc(), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merged(partial: DataFrame, k: int, parts: int) -> DataFrame:
    """The k best of ``(qid, part, chunk_id, score)``: lists of at most ``MERGE`` parts meet at a time."""
    while parts > MERGE:
        parts = -(-parts // MERGE)
        partial = rank_in(partial.withColumn("part", F.pmod("part", F.lit(parts))), k, "qid", "part").drop("rank")
    return rank_in(partial.drop("part"), k, "qid")
