"""Two-stage retrieval: dense top-k, then optional MMR or listwise reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.prompts import parse_order, rerank_prompt
from passagemill.functions.text import snippet
from passagemill.operators.vectors import TIE_DECIMALS, exact_topk
from passagemill.options import RetrievalOptions

# A result of at most this many rows may be shipped to every task, unless a caller sets another limit.
BROADCAST_ROWS = 200_000


def dense_topk(queries: DataFrame, collection: DataFrame, options: RetrievalOptions) -> DataFrame:
    return exact_topk(queries, collection, options.top_k, options.max_broadcast_queries)


def candidate_pool(queries: DataFrame, collection: DataFrame, options: RetrievalOptions) -> DataFrame:
    """The over-fetched pool: ``max(fetch_k, top_k)`` passages per query."""
    return exact_topk(queries, collection, options.candidate_k, options.max_broadcast_queries)


def rows_bound(queries: DataFrame, k: int, options: RetrievalOptions) -> int | None:
    """The most rows a top-k of these queries can have; None for a batch beyond the limit.

    Only the queries are counted, the search itself is not run.
    """
    limit = options.max_broadcast_queries
    n = queries.select("qid").limit(limit + 1).count()
    return n * k if n <= limit else None


def attach(
    ranked: DataFrame, collection: DataFrame, columns: list[str], bound: int | None, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Join winners back to wide columns that the search did not carry.

    With a proven ``bound`` of at most ``limit`` rows the winners are broadcast and the collection is only
    scanned; otherwise both sides are shuffled on the chunk.
    """
    side = F.broadcast(ranked) if bound is not None and bound <= limit else ranked
    return collection.select("chunk_id", *columns).join(side, "chunk_id")


def mmr(pool: DataFrame, options: RetrievalOptions) -> DataFrame:
    """Reorder each query's pool by relevance minus likeness to what is already chosen.

    ``pool(qid, rank, chunk_id, score, embedding)`` holds one bounded group per
    query.  The first pick is dense rank 1 and ties go to the better dense rank.  A pool
    with a missing or misshapen vector keeps its dense order.
    """
    k, weight = options.top_k, options.mmr_lambda

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        dense = rows.head(k)[["qid", "rank", "chunk_id", "score"]].assign(dense_rank=lambda r: r["rank"])
        dense = dense[["qid", "rank", "chunk_id", "dense_rank", "score"]]
        if rows["embedding"].isna().any() or rows["embedding"].map(len).nunique() != 1:
            return dense
        vectors = np.stack(rows["embedding"]).astype(float)
        if not np.isfinite(vectors).all():
            return dense
        sizes = np.linalg.norm(vectors, axis=1)
        gram = vectors @ vectors.T
        likeness = np.divide(gram, np.outer(sizes, sizes), out=np.zeros_like(gram), where=np.outer(sizes, sizes) > 0)
        picked = [0]
        nearest = likeness[0].copy()
        values = [np.nan]
        while len(picked) < min(k, len(rows)):
            value = np.round(weight * rows["score"].to_numpy() - (1 - weight) * nearest, TIE_DECIMALS)
            value[picked] = -np.inf
            best = int(np.argmax(value))
            picked.append(best)
            values.append(value[best])
            nearest = np.maximum(nearest, likeness[best])
        out = rows.loc[picked, ["qid", "chunk_id", "rank", "score"]].rename(columns={"rank": "dense_rank"})
        out["rank"] = np.arange(1, len(picked) + 1, dtype="int32")
        return out[["qid", "rank", "chunk_id", "dense_rank", "score"]]

    return pool.groupBy("qid").applyInPandas(
        choose, "qid long, rank int, chunk_id long, dense_rank int, score double"
    )


def rerank_prompts(pool: DataFrame, queries: DataFrame, options: RetrievalOptions) -> DataFrame:
    """``(qid, prompt)`` for queries whose pool is larger than ``top_k``; others need no model."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), snippet(F.col("text")))
    listing = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return (
        pool.groupBy("qid")
        .agg(listing.alias("listing"))
        .where(F.size("listing") > options.top_k)
        .join(queries.select("qid", "query"), "qid")
        .select(
            "qid",
            rerank_prompt(
                F.col("query"), F.array_join(F.transform("listing", lambda r: r["line"]), "\n"), options.top_k
            ).alias("prompt"),
        )
    )


def listwise_rerank(pool: DataFrame, replies: DataFrame, options: RetrievalOptions) -> DataFrame:
    """Reorder each pool by its ``(qid, reply)``; a missing reply keeps the dense order."""
    ids = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score")))
    grouped = pool.groupBy("qid").agg(ids.alias("pool")).join(replies, "qid", "left")
    n = F.size("pool")
    order = F.when(n <= options.top_k, F.sequence(F.lit(0), n - 1)).otherwise(parse_order(F.col("reply"), n))
    return (
        grouped.select("qid", "pool", F.slice(order, 1, options.top_k).alias("order"))
        .select("qid", "pool", F.posexplode("order").alias("at", "index"))
        .select(
            "qid",
            (F.col("at") + 1).alias("rank"),
            F.get("pool", F.col("index"))["chunk_id"].alias("chunk_id"),
            F.get("pool", F.col("index"))["rank"].alias("dense_rank"),
            F.get("pool", F.col("index"))["score"].alias("score"),
        )
    )


def retrieve(
    queries: DataFrame, collection: DataFrame, options: RetrievalOptions, replies: DataFrame | None = None
) -> DataFrame:
    """``(qid, rank, chunk_id, dense_rank, score)`` by the chosen backend.

    An unknown backend is ``none``; a listwise run without replies is dense order.
    """
    if options.backend == "mmr":
        pool = candidate_pool(queries, collection, options)
        bound = rows_bound(queries, options.candidate_k, options)
        return mmr(attach(pool, collection, ["embedding"], bound), options)
    if options.backend == "llm" and replies is not None:
        return listwise_rerank(candidate_pool(queries, collection, options), replies, options)
    return dense_topk(queries, collection, options).withColumn("dense_rank", F.col("rank"))
