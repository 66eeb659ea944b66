"""Exact vector search: cosine top-k and score profiles.

Vectors are ``array<float>`` or ``array<double>`` columns and are compared in
double precision.  Scores are compared after rounding to 12 decimals, so equal
vectors tie and the lower id wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.operators import parts
from passagemill.operators.parts import STEP_VALUES, TIE_DECIMALS, matrix

BLOCK_QUERIES = 1024


def _cosine(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    # Dividing the plain dot product by both norms keeps scores of whole-number
    # vectors exact up to the last division, whatever order the product is summed in.
    sizes = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1))
    dots = queries @ vectors.T
    return np.divide(dots, sizes, out=np.zeros_like(dots), where=sizes > 0)


class _Best:
    """The k best ids per query seen so far, as flat arrays sorted by query, score, id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.query = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int64)
        self.keys = np.empty(0)
        self.scores = np.empty(0)
        self.bar = np.full(n_queries, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray, banned: np.ndarray | None = None) -> None:
        if scores.shape[1] == 0:
            return
        keys = np.round(scores, TIE_DECIMALS)
        if banned is not None:
            keys = np.where(ids[None, :] == banned[:, None], -np.inf, keys)
        bar = self.bar
        if keys.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(keys, keys.shape[1] - self.k, axis=1)[:, -self.k])
        # Everything that ties with the k-th score stays in until the ids decide.
        query, column = np.nonzero((keys >= bar[:, None]) & np.isfinite(keys))
        self.push(query, ids[column], keys[query, column], scores[query, column])

    def push(self, query: np.ndarray, ids: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        self.query = np.concatenate([self.query, query])
        self.ids = np.concatenate([self.ids, ids])
        self.keys = np.concatenate([self.keys, keys])
        self.scores = np.concatenate([self.scores, scores])
        order = np.lexsort((self.ids, -self.keys, self.query))
        place = np.arange(len(order)) - np.searchsorted(self.query[order], self.query[order])
        order, place = order[place < self.k], place[place < self.k]
        self.query, self.ids, self.keys, self.scores = (
            part[order] for part in (self.query, self.ids, self.keys, self.scores)
        )
        full = place == self.k - 1
        self.bar[self.query[full]] = self.keys[full]

    def rows(self, qids: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"qid": qids[self.query], "chunk_id": self.ids, "score": self.scores})


_PARTIAL = "qid long, chunk_id long, score double"


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows whose vector is there, has no missing part and, with ``dim``, that many parts."""
    v = F.col("embedding")
    fits = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return vectors.where(fits if dim is None else fits & (F.size(v) == dim))


def vector_faults(vectors: DataFrame, dim: int) -> DataFrame:
    """One row: ``n_vectors``, and how many of them a search leaves out as missing or misshapen."""
    v = F.col("embedding")
    missing = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return vectors.select(missing.alias("missing"), F.size(v).alias("size")).agg(
        F.count("*").alias("n_vectors"),
        F.count_if(F.col("missing")).alias("n_missing"),
        F.count_if(~F.col("missing") & (F.col("size") != dim)).alias("n_misshapen"),
    )


@dataclass(frozen=True)
class _Few:
    """So few queries that every task of the collection gets them all: ids and vectors by size of the vectors."""

    by_size: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, queries: DataFrame, limit: int) -> _Few | None:
        """None for more than ``limit`` queries; no more than that are ever on the driver."""
        rows = usable(queries.select(F.col("qid").cast("long").alias("qid"), "embedding")).limit(limit + 1).toArrow()
        if rows.num_rows > limit:
            return None
        ids, vectors = rows["qid"].to_numpy(), rows["embedding"].to_pylist()
        sizes = np.array([len(v) for v in vectors], np.int64)
        return cls({int(n): (ids[sizes == n], np.array([v for v in vectors if len(v) == n], float)) for n in np.unique(sizes)})


def _of_size(rows: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of the rows ``(id, vector)`` whose vectors have ``n`` parts."""
    of_n = pc.equal(pc.list_value_length(rows.column(1)), n)
    fits = rows if pc.all(of_n).as_py() else rows.filter(of_n)
    return fits.column(0).to_numpy(), matrix(fits.column(1))


def _vectors(table: DataFrame, key: str) -> DataFrame:
    return usable(table.select(F.col(key).cast("long").alias("id"), F.col("embedding")))


def _in_parts(queries: DataFrame, collection: DataFrame, work: parts.Work, schema: str) -> tuple[DataFrame, int]:
    """``work`` for all queries in all parts of the collection, each table read and shuffled once; and the number of parts times groups of queries."""
    held = _vectors(collection, "chunk_id")
    count, dim = held.agg(F.count("*"), F.max(F.size("embedding"))).first()
    n = -(-count // parts.part_rows(dim)) if count else 1
    groups = parts.query_groups(count, n)  # several tasks share a part's queries
    of_query = F.pmod(F.xxhash64("id"), F.lit(groups))
    asked = _vectors(queries, "qid").select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("at"), of_query.alias("group"), "id", "embedding")
    copies = held.select(parts.dealt(held, "id", n).alias("at"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "id", "embedding")
    part = (F.col("at") * groups + F.col("group")).alias("part")
    return parts.meet(*(side.select(part, "id", "embedding") for side in (copies, asked)), work, schema, n * groups), n * groups


def _pairs(held: pa.RecordBatch, asked: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(qids, queries, ids, vectors) of equal sizes, in steps whose scores fit in memory."""
    for n in pc.unique(pc.list_value_length(asked.column(1))).to_pylist():
        ids, vectors = _of_size(held, n)
        qids, queries = _of_size(asked, n)
        step = max(1, STEP_VALUES // max(1, len(ids)))
        for k in range(0, len(qids) if len(ids) else 0, step):
            yield qids[k : k + step], queries[k : k + step], ids, vectors


def exact_topk(
    queries: DataFrame,
    collection: DataFrame,
    k: int,
    max_broadcast_queries: int = BLOCK_QUERIES,
    skip_same_id: bool = False,
) -> DataFrame:
    """``(qid, rank, chunk_id, score)``: the k most similar vectors of every query, exactly.

    ``queries(qid, embedding)``, ``collection(chunk_id, embedding)`` with long ids.  Up to
    ``max_broadcast_queries`` queries are shipped to the tasks and the collection is not
    shuffled; more queries meet the collection part by part.  Either way it is read once.
    Missing and misshapen vectors, of queries or of the collection, take no part;
    ``vector_faults`` counts them.
    """
    few = _Few.of(queries, max_broadcast_queries)

    def past_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: _Best(len(qids), k) for n, (qids, _) in few.by_size.items()}
        for batch in batches:
            for n, (qids, asked) in few.by_size.items():
                ids, vectors = _of_size(batch, n)
                step = max(1, STEP_VALUES // len(qids))
                for a in range(0, len(ids), step):
                    best[n].add(_cosine(asked, vectors[a : a + step]), ids[a : a + step], qids if skip_same_id else None)
        for n, (qids, _) in few.by_size.items():
            yield pa.RecordBatch.from_pandas(best[n].rows(qids), preserve_index=False)

    def in_part(part: int, held: pa.RecordBatch, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for qids, wanted, ids, vectors in _pairs(held, asked):
            best = _Best(len(qids), k)
            best.add(_cosine(wanted, vectors), ids, qids if skip_same_id else None)
            found = best.rows(qids)
            found.insert(1, "part", part)
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    if few is None:
        partial, n = _in_parts(queries, collection, in_part, "qid long, part long, chunk_id long, score double")
        ranked = parts.merged(partial, k, n)
    else:
        ranked = parts.rank_in(_vectors(collection, "chunk_id").mapInArrow(past_all, _PARTIAL), k, "qid")
    return ranked.select("qid", "rank", "chunk_id", "score")


_SUMS = "qid long, n long, total double, low double, high double"


def _sums(qids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "qid": qids,
            "n": np.full(len(qids), scores.shape[1]),
            "total": scores.sum(axis=1),
            "low": scores.min(axis=1),
            "high": scores.max(axis=1),
        }
    )


def score_profile(queries: DataFrame, collection: DataFrame, max_broadcast_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Per query over the whole collection: how many vectors, and least, mean and best cosine.

    Scores of all pairs are computed but only their sums leave a task.
    """
    few = _Few.of(queries, max_broadcast_queries)

    def past_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (qids, asked) in few.by_size.items():
                _, vectors = _of_size(batch, n)
                step = max(1, STEP_VALUES // len(qids))
                for a in range(0, len(vectors), step):
                    yield _sums(qids, _cosine(asked, vectors[a : a + step]))

    def in_part(part: int, held: pa.RecordBatch, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for qids, wanted, _, vectors in _pairs(held, asked):
            yield _sums(qids, _cosine(wanted, vectors))

    if few is None:
        partial, _ = _in_parts(queries, collection, in_part, _SUMS)
    else:
        partial = _vectors(collection, "chunk_id").mapInArrow(past_all, _SUMS)
    return partial.groupBy("qid").agg(
        F.sum("n").alias("n_vectors"),
        F.min("low").alias("min_score"),
        (F.sum("total") / F.sum("n")).alias("mean_score"),
        F.max("high").alias("max_score"),
    )


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query, the share of the true neighbours that were found."""
    hits = truth.select("qid", "chunk_id").join(
        found.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left"
    )
    return hits.groupBy("qid").agg(
        F.count("*").alias("k"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("found"),
        (F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"),
    )
