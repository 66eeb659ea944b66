"""Approximate vector search in a stored index: cells of a coarse quantiser and compressed residuals.

``build`` learns centroids from a bounded sample of unit vectors, puts every vector of the
collection into the cell of its nearest centroid, and writes the residual (what the centroid
leaves over) as one signed byte a dimension beside the vector.  The table is partitioned by
cell.  ``search`` ranks the centroids for each query, reads the codes of the first cells
only, keeps the best by code, and scores those again with their full vectors.  Neighbouring
cells make up buckets of bounded size: a query is sent to a bucket once, with the cells that
it probes there, and gets back the best of the bucket, not of each cell.

How many cells a query has to probe depends on the data: clustered vectors need few, vectors
without structure many.  ``build`` measures it: neighbours of sampled vectors among the
sample, looked up by cell, must reach ``target`` recall on average.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators import parts
from passagemill.operators.parts import STEP_VALUES, matrix
from passagemill.operators.vectors import usable

BUCKET_ROWS = 4_096  # vectors below which a bucket is not worth a task of its own
GROUP_ROWS = 16_384  # queries that a task answers from its bucket, about


@dataclass(frozen=True)
class CellOptions:
    sample: int = 32_768  # vectors that centroids and probes are fitted on, at most
    per_cell: int = 16  # sampled vectors for each cell
    rounds: int = 12
    target: float = 0.97  # recall that the number of probes must reach on the sample
    judged: int = 512  # sampled vectors that the recall is measured with
    neighbours: int = 10
    again: int = 8  # times k, so many of the best by code are scored exactly
    rows_per_file: int = 1_000_000
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Bounded by ``CellOptions.sample``: one centroid for each ``per_cell`` sampled vectors."""

    centroids: np.ndarray
    scale: float  # of one step of a residual's byte
    probes: int
    share: np.ndarray  # of the sample in each cell


def _units(vectors: np.ndarray) -> np.ndarray:
    sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, sizes, out=np.zeros_like(vectors), where=sizes > 0)


def _nearest(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, in steps whose scores are bounded."""
    step = max(1, STEP_VALUES // max(1, len(centroids)))
    found = [(units[a : a + step] @ centroids.T).argmax(axis=1) for a in range(0, len(units), step)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _centroids(units: np.ndarray, n: int, options: CellOptions) -> np.ndarray:
    """Spherical k-means; a cell that runs empty keeps its centroid."""
    rng = np.random.default_rng(options.seed)
    found = units[rng.choice(len(units), n, replace=False)].copy()
    for _ in range(options.rounds):
        cell = _nearest(units, found)
        sums = np.zeros_like(found)
        np.add.at(sums, cell, units)
        some = np.linalg.norm(sums, axis=1) > 0
        found[some] = _units(sums[some])
    return found


def _probes(units: np.ndarray, centroids: np.ndarray, options: CellOptions) -> int:
    """The fewest cells that hold ``target`` of the sample's nearest neighbours, on average."""
    asked = units[: options.judged]
    alike = asked @ units.T
    alike[np.arange(len(asked)), np.arange(len(asked))] = -2
    k = min(options.neighbours, len(units) - 1)
    if k < 1:
        return len(centroids)
    near = np.argpartition(-alike, k - 1, axis=1)[:, :k]
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, _nearest(units, centroids)[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(options.target * len(needed))) - 1)]) + 1


def fit(collection: DataFrame, options: CellOptions = CellOptions()) -> Model | None:
    """Centroids, code steps and probes from at most ``sample`` vectors, those whose ids hash lowest."""
    good = usable(collection.select("chunk_id", "embedding"))
    draw = F.xxhash64(F.lit(options.seed), "chunk_id")
    rows = good.orderBy(draw, "chunk_id").limit(options.sample).toArrow()  # a bounded top-k
    if not rows.num_rows:
        return None
    sizes = pc.list_value_length(rows["embedding"]).to_numpy()
    usual = int(np.bincount(sizes).argmax())
    units = _units(matrix(rows.filter(pa.array(sizes == usual))["embedding"]))
    centroids = _centroids(units, max(1, len(units) // options.per_cell), options)
    cell = _nearest(units, centroids)
    rest = np.abs(units - centroids[cell])
    share = np.bincount(cell, minlength=len(centroids)) / len(units)
    return Model(centroids, float(max(rest.max(), 1e-12)) / 127, _probes(units, centroids, options), share)


def build(collection: DataFrame, path: str, options: CellOptions = CellOptions()) -> None:
    """Write the index of ``collection(chunk_id, embedding)``: ``rows`` by cell, ``cells`` and ``model``.

    Vectors of another size than most, and missing ones, are left out.
    """
    spark = collection.sparkSession
    model = fit(collection, options)
    if model is None:
        model = Model(np.zeros((0, 0)), 1.0, 0, np.zeros(0))
    centroids, scale, dim = model.centroids, model.scale, model.centroids.shape[1]
    # a cell that holds very many vectors is written by several tasks
    files = 1 + (model.share * collection.count() / options.rows_per_file).astype(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(matrix(batch.column(1)))
            if not len(units):
                continue
            cell = _nearest(units, centroids)
            codes = np.clip(np.rint((units - centroids[cell]) / scale), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell.astype(np.int64)), pa.array(batch.column(0).to_numpy() % files[cell])],
                ["chunk_id", "embedding", "code", "cell", "file"],
            )

    kind = collection.schema["embedding"].dataType.simpleString()
    good = usable(collection.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding"), dim)
    rows = good.mapInArrow(place, f"chunk_id long, embedding {kind}, code binary, cell long, file long")
    rows.repartition("cell", "file").drop("file").write.partitionBy("cell").parquet(f"{path}/rows")
    sizes = spark.read.schema("chunk_id long, cell long").parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"))
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell long, centroid array<double>")
    centres.join(sizes, "cell", "left").select("cell", "centroid", F.coalesce("n", F.lit(0)).alias("n")).write.parquet(f"{path}/cells")
    spark.createDataFrame([(scale, model.probes, kind)], "scale double, probes int, vectors string").write.parquet(f"{path}/model")


@dataclass(frozen=True)
class Found:
    top: DataFrame  # qid, rank, chunk_id, score
    effort: DataFrame  # qid, coded, scored: vectors compared by code and by their full numbers


def buckets(size: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(first, subs, count)``: the first bucket of each cell and how many it has, and the number of buckets.

    Neighbouring cells share a bucket of less than twice the bound; a cell beyond the bound
    has buckets of its own.
    """
    bound = min(parts.part_rows(dim), max(BUCKET_ROWS, -(-int(size.sum()) // parts.TASKS)))
    large = size > bound
    small = np.where(large, 0, size)
    first = (np.cumsum(small) - small) // bound
    shared = int(first.max()) + 1 if len(first) else 0
    subs = np.where(large, -(-size // bound), 1)
    own = np.where(large, subs, 0)
    return np.where(large, shared + np.cumsum(own) - own, first), subs, shared + int(own.sum())


def search(spark: SparkSession, queries: DataFrame, path: str, k: int, options: CellOptions = CellOptions(), probes: int | None = None) -> Found:
    """The k best of each query ``(qid, embedding)`` among the cells that it probes."""
    model = spark.read.parquet(f"{path}/model").first()
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()  # bounded by the fitted sample
    centroids, size = matrix(cells["centroid"]), cells["n"].to_numpy()
    scale, most = model["scale"], model["probes"] if probes is None else probes
    dim = centroids.shape[1]
    first, subs, count = buckets(size, dim)
    keep = k * options.again
    asked = usable(queries.select(F.col("qid").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")), dim)
    few = max(1, STEP_VALUES // max(1, len(centroids), count * dim))  # queries of a step: each may go to all buckets

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each bucket of a query, with the cells that it probes there and their number of vectors."""
        for batch in batches:
            for a in range(0, batch.num_rows, few):
                some = batch.slice(a, few)
                units = _units(matrix(some.column(1)))
                order = np.argsort(-(units @ centroids.T), axis=1, kind="stable")[:, :most]
                row, cell = np.repeat(np.arange(len(units)), order.shape[1]), order.ravel()
                row, cell = row[size[cell] > 0], cell[size[cell] > 0]
                if not len(cell):
                    continue
                sort = np.lexsort((first[cell], row))
                row, cell = row[sort], cell[sort]
                at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (first[cell[1:]] != first[cell[:-1]])))
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(cell)), pa.int32()), pa.array(cell))
                times = subs[cell[at]]  # a cell of several buckets is alone in them
                run = np.repeat(np.arange(len(at)), times)
                sub = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
                whose = pa.array(row[at][run])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(whose), some.column(1).take(whose), pa.array(first[cell[at]][run] + sub), lists.take(pa.array(run)), pa.array(np.where(sub == 0, np.add.reduceat(size[cell], at)[run], 0))],
                    ["id", "embedding", "bucket", "cells", "n"],
                )

    wanted = asked.mapInArrow(probed, "id long, embedding array<double>, bucket long, cells array<long>, n long")
    # the list of probed cells is no longer than the model
    chosen = [r["cell"] for r in wanted.select(F.explode("cells").alias("cell")).distinct().collect()] if len(size) else []
    groups = -(-asked.count() // GROUP_ROWS) or 1
    layout = spark.createDataFrame([(i, int(b), int(s)) for i, (b, s) in enumerate(zip(first, subs))], "cell long, first long, subs int")
    kind = model["vectors"]
    rows = spark.read.schema(f"chunk_id long, embedding {kind}, code binary, cell long").parquet(f"{path}/rows").where(F.col("cell").isin(chosen))
    place = F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("subs"))
    copies = rows.join(layout, "cell").select("cell", F.col("chunk_id").alias("id"), "code", place.alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    part = (F.col("bucket") * groups + F.col("group")).alias("part")
    none = lambda type_, name: F.lit(None).cast(type_).alias(name)
    held = copies.select(part, "cell", "id", "code", none("array<long>", "cells"), none("array<double>", "embedding"))
    grouped = wanted.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)))
    asked_parts = grouped.select(part, none("long", "cell"), "id", none("binary", "code"), "cells", "embedding")

    def by_code(number: int, kept: pa.RecordBatch, some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cell, ids, qids = kept.column(0).to_numpy(), kept.column(1).to_numpy(), some.column(1).to_numpy()
        codes = np.frombuffer(b"".join(kept.column(2).to_pylist()), np.int8).reshape(kept.num_rows, -1)
        vectors = codes * np.float32(scale) + centroids.astype(np.float32)[cell]
        step = max(1, STEP_VALUES // max(len(ids), len(centroids)))
        for a in range(0, len(qids), step):
            lists = some.column(3).slice(a, step)
            opened = np.zeros((len(lists), len(centroids)), bool)
            opened[np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()] = True
            far = -(_units(matrix(some.column(4).slice(a, step))).astype(np.float32) @ vectors.T)
            far[~opened[:, cell]] = np.inf
            best = np.argpartition(far, keep - 1, axis=1)[:, :keep] if far.shape[1] > keep else np.tile(np.arange(far.shape[1]), (len(far), 1))
            row, found = np.repeat(np.arange(len(far)), best.shape[1]), best.ravel()
            there = np.isfinite(far[row, found])
            row, found = row[there], found[there]
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[a : a + step][row]), pa.array(cell[found]), pa.array(ids[found]), pa.array(-far[row, found].astype(float))],
                ["qid", "cell", "chunk_id", "score"],
            )

    coded = parts.meet(held, asked_parts, by_code, "qid long, cell long, chunk_id long, score double", max(1, count * groups))
    best = parts.rank_in(coded, keep, "qid").select("qid", "chunk_id", "cell")
    pairs = best.join(rows.select("cell", "chunk_id", F.col("embedding").cast("array<double>").alias("v")), ["cell", "chunk_id"])
    pairs = pairs.join(asked.select(F.col("id").alias("qid"), "embedding"), "qid")

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = matrix(batch.column(2)), matrix(batch.column(3))
            size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
            dots = (a * b).sum(axis=1) if batch.num_rows else np.zeros(0)
            scores = np.divide(dots, size, out=np.zeros_like(dots), where=size > 0) if batch.num_rows else dots
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], ["qid", "chunk_id", "score"])

    scored = pairs.select("qid", "chunk_id", "v", "embedding").mapInArrow(exactly, "qid long, chunk_id long, score double")
    effort = wanted.groupBy(F.col("id").alias("qid")).agg(F.sum("n").alias("coded"), F.least(F.sum("n"), F.lit(keep)).alias("scored"))
    return Found(parts.rank_in(scored, k, "qid").select("qid", "rank", "chunk_id", "score"), effort)
