"""Running state over ordered rows, without unbounded work in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span_if_long(df: DataFrame, pos: str, span: int) -> int | None:
    """``span`` when some key reaches past that many positions, else None.

    Positions start at 0, so None proves that every key holds at most ``span``
    rows and may be sorted as a whole in one task.
    """
    top = df.agg(F.max(pos)).first()[0]
    return span if top is not None and top >= span else None


def carry_forward(
    df: DataFrame, keys: list[str], pos: str, marks: dict[str, Column], span: int | None
) -> DataFrame:
    """Add, for every row, the latest non-null mark at or before it within its key.

    Without ``span`` this is a plain window.  With it a key is cut into spans of
    positions: each span is sorted alone, its last mark is handed to the later
    spans through a table of one row per span, and joined back on (key, span).
    Both give the same rows.
    """
    rows = (Window.unboundedPreceding, Window.currentRow)
    if span is None:
        whole = Window.partitionBy(*keys).orderBy(pos).rowsBetween(*rows)
        return df.withColumns({name: F.last(mark, ignorenulls=True).over(whole) for name, mark in marks.items()})

    inside = Window.partitionBy(*keys, "_span").orderBy(pos).rowsBetween(*rows)
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_span", F.floor(F.col(pos) / span).cast("long")).withColumns(
        {f"_here_{name}": F.last(mark, ignorenulls=True).over(inside) for name, mark in marks.items()}
    )
    # Already grouped by (key, span): no second shuffle of the rows.
    tails = local.groupBy(*keys, "_span").agg(
        *[F.max_by(f"_here_{name}", F.col(pos)).alias(f"_tail_{name}") for name in marks]
    )
    carried = tails.select(
        *keys,
        "_span",
        *[F.last(f"_tail_{name}", ignorenulls=True).over(before).alias(f"_before_{name}") for name in marks],
    )
    return local.join(carried, [*keys, "_span"]).select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(f"_here_{name}", f"_before_{name}").alias(name) for name in marks],
    )


def number_rows(
    df: DataFrame, keys: list[str], coarse: list[str], fine: list[str], name: str, total: str
) -> DataFrame:
    """Number the rows of every key from 0 in ``(coarse, fine)`` order and add their count.

    Only a coarse group is sorted in one task; its first number comes from the counts
    of the groups before it, one row per group.
    """
    group = [*keys, *coarse]
    counts = df.groupBy(*group).agg(F.count("*").alias("_n"))
    ordered = Window.partitionBy(*keys).orderBy(*coarse)
    offsets = counts.select(
        *group,
        F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).cast("int").alias(total),
    )
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*fine))
    return (
        df.withColumn("_place", place)
        .join(offsets, group)
        .withColumn(name, (F.col("_offset") + F.col("_place") - 1).cast("int"))
        .drop("_place", "_offset")
    )
