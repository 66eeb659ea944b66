"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of all words by its weight; a target above ``most`` times the
source's words is cut there and the excess goes to the others by weight, until none is
above (``targets``).  A source whose target is k times its words and a rest gives every
document k times (whole epochs come first); the rest is a sample without replacement:
each document draws an exponential key divided by its quality weight, and documents are
taken in the order of their keys until the words reach the rest.  The document at the border
is taken if that comes nearer.

Only DataFrame functions run.  A source is never sorted in one task: keys are mapped to
[0, 1) and cut into ``cells`` cells, and the cell where the running sum meets the rest into
as many again; only the documents of that small cell are ordered.  The result of the search is one
row per source, the border key, against which every document is compared where it lies.

Edge cases: a null text has no words and takes none; a source without words has target 0;
null is a source of its own, last; null ids draw their key from their text; repeated rows
share one key and are taken or left together; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm import common


@dataclass(frozen=True)
class MixOptions:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # of the sources in their order, repeating
    most: int = 3
    cells: int = 1_024
    seed: int = 7


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1: highest where a word and its space take about seven characters."""
    return 1 / (1 + F.abs(F.log((F.coalesce(F.length(text), F.lit(0)) + 7) / (7.0 * (size + 1)))))


def drawn(docs: DataFrame, options: MixOptions = MixOptions(), prefix: str = "") -> DataFrame:
    """The rows with ``size``, ``place`` in [0, 1) (a growing function of the exponential key) and ``tie``."""
    size, place, tie = f"{prefix}size", f"{prefix}place", f"{prefix}tie"
    hashed = F.xxhash64(F.lit(options.seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text")))
    unit = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / float(1 << 53)
    sized = docs.withColumn(size, words(F.col("text")))
    key = -F.log(unit) / quality_weight(F.col("text"), F.col(size))
    return sized.withColumn(place, 1 - F.exp(-key / 2)).withColumn(tie, hashed)


def targets(sizes: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above its limit.

    Sources are few against documents: one row each.  With sources ordered by limit over
    weight, the ones cut at their limit come first; each row sees what is left for it
    and the ones after it.
    """
    weights = F.array(*[F.lit(float(w)) for w in options.weights])
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source").cast("string"), "UTF-8"))
    listed = sizes.withColumn("turn", F.row_number().over(order) - 1)
    listed = listed.withColumn("weight", F.element_at(weights, (F.col("turn") % len(options.weights) + 1).cast("int")))
    listed = listed.withColumn("limit", F.col("source_size") * float(options.most))
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "turn")
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    listed = listed.withColumn("level", level).withColumn("cut", F.col("level") * F.col("weight") >= F.col("limit"))
    # the first source that is not cut sets the level of all that follow
    listed = listed.withColumn("shared", F.first(F.when(~F.col("cut"), F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("shared").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("shared") * F.col("weight")))
    return listed.select("source", "source_size", target.alias("target"))


def borders(rows: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """One row per source: source_size, target, whole epochs, and the border (place, tie) up to which the rest is taken.

    ``rows`` has (source, size, place, tie).
    """
    n = options.cells
    fine = rows.withColumn("cell", F.floor(F.col("place") * n * n)).groupBy("source", "cell").agg(F.sum("size").alias("size"))
    fine = common.staged(fine.select("source", F.floor(F.col("cell") / n).alias("coarse"), (F.col("cell") % n).alias("fine"), "size"))
    coarse = fine.groupBy("source", "coarse").agg(F.sum("size").alias("size"))
    goal = targets(coarse.groupBy("source").agg(F.sum("size").alias("source_size")), options)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0))
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    goal = common.staged(goal)

    def reached(cells: DataFrame, order: list[str]) -> DataFrame:
        """Per source, the first entry at which the running sum reaches what is to be taken, with the sum before it."""
        running = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = cells.withColumn("upto", F.sum("size").over(running)).where("upto >= rest and rest > 0")
        first = F.min_by(F.struct(*order, "rest", "size", (F.col("upto") - F.col("size")).alias("before")), F.struct(*order))
        return summed.groupBy("source").agg(first.alias("at")).select("source", "at.*")

    def of(cells: DataFrame, found: DataFrame, *cell: str) -> DataFrame:
        """The entries inside each source's cell, with what is left to take there."""
        left = found.select(F.col("source").alias("s"), *[F.col(c).alias(f"_{c}") for c in cell], (F.col("rest") - F.col("before")).alias("rest"))
        same = F.col("source").eqNullSafe(F.col("s"))
        for c in cell:
            same = same & (F.col(c) == F.col(f"_{c}"))
        return cells.join(left, same).drop("s", *[f"_{c}" for c in cell])

    needed = goal.select(F.col("source").alias("s"), "rest")
    one = reached(coarse.join(needed, F.col("source").eqNullSafe(F.col("s"))).drop("s"), ["coarse"])
    two = reached(of(fine, one, "coarse"), ["fine"])
    cell = two.join(one.select(F.col("source").alias("s"), "coarse"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cell = cell.withColumn("cell", F.col("coarse") * n + F.col("fine"))
    inside = of(rows.withColumn("cell", F.floor(F.col("place") * n * n)), cell, "cell").groupBy("source", "place", "tie", "rest").agg(F.sum("size").alias("size"))
    three = reached(inside, ["place", "tie"])
    # the border entry itself is taken if that comes nearer
    edge = three.select(F.col("source").alias("s"), F.col("place").alias("edge_place"), F.col("tie").alias("edge_tie"), (F.col("rest") - F.col("before") >= F.col("size") / 2).alias("edge_taken"))
    return common.staged(goal.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def _taken(prefix: str = "") -> Column:
    """How often a row joined to its source's border is taken."""
    place, tie = F.col(f"{prefix}place"), F.col(f"{prefix}tie")
    inside = (place < F.col("edge_place")) | ((place == F.col("edge_place")) & ((tie < F.col("edge_tie")) | ((tie == F.col("edge_tie")) & F.col("edge_taken"))))
    return F.coalesce(F.col("epochs"), F.lit(0)) + F.when(inside, 1).otherwise(0)


def mix(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    rows = common.staged(drawn(docs.select("doc_id", "source", "text"), options).drop("text"))
    edge = borders(rows.select("source", "size", "place", "tie"), options).withColumnRenamed("source", "s")
    joined = rows.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _taken()).cast("long").alias("taken"))


def mixed(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """The rows, with all their columns, each as often as the mix takes it."""
    rows = common.staged(drawn(docs.select("doc_id", "source", "text"), options).drop("text"))
    edge = borders(rows.select("source", "size", "place", "tie"), options)
    edge = edge.select(F.struct("source", "epochs", "edge_place", "edge_tie", "edge_taken").alias("_edge"))
    whole = drawn(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "text"), options).drop("text")
    joined = whole.join(edge, F.col("source").eqNullSafe(F.col("_edge.source")), "left")
    flat = joined.select("_row", "place", "tie", "_edge.epochs", "_edge.edge_place", "_edge.edge_tie", "_edge.edge_taken")
    repeated = flat.select("_row", F.explode(F.array_repeat(F.lit(0), _taken().cast("int"))).alias("_time"))
    return repeated.select("_row.*")
