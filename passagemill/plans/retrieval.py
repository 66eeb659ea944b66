"""Vector search, reranking and prompt queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.prompts import NO_RESULTS, SYSTEM_RULES, parse_order
from passagemill.functions.prompts import RERANK_HEAD, RERANK_PASSAGES, RERANK_TAIL_A, RERANK_TAIL_B
from passagemill.operators import context as ctx
from passagemill.operators import retrieval as rt
from passagemill.operators import cells, vectors
from passagemill.options import RetrievalOptions
from passagemill.plans import tables as t
from passagemill.plans.registry import query
from passagemill.sources.sinks import scratch_dir

DEFAULT = RetrievalOptions()


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def search_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return t.label_queries(spark, sf_dir), t.vector_collection(spark, sf_dir)


def question_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return t.question_queries(spark, sf_dir), t.document_collection(spark, sf_dir)


# -- vectors -------------------------------------------------------------


@query(
    f"""WITH {t.LABEL_SEARCH} SELECT qid, count(*) AS n_vectors, round(min(score), 6) AS min_score,
      round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score FROM scored GROUP BY qid"""
)
def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = vectors.score_profile(*search_inputs(spark, sf_dir))
    return profile.select("qid", "n_vectors", *[F.round(c, 6).alias(c) for c in ("min_score", "mean_score", "max_score")])


def own_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries of the index: every vector whose id is divisible by 50."""
    held = t.table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return held.select(F.col("vec_id").alias("qid"), "embedding")


def found_by_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, cells.Found]:
    """The stated queries, the collection, and what a new index of it finds for them."""
    queries, collection = own_queries(spark, sf_dir), t.vector_collection(spark, sf_dir)
    path = scratch_dir(spark, "cells")
    cells.build(collection, path)
    return queries, collection, cells.search(spark, queries, path, DEFAULT.top_k)


@query()
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the index against exact search, per query."""
    queries, collection, found = found_by_cells(spark, sf_dir)
    return vectors.recall_at_k(found.top, rt.dense_topk(queries, collection, DEFAULT))


@query(
    """SELECT count(*) FILTER (vec_id % 50 = 0) AS n_queries, count(*) AS n_indexed, true AS recall_reached, true AS few_scored,
    count(*) FILTER (vec_id % 50 = 0) AS found_itself FROM embeddings"""
)
def ann_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of at least 0.9 on average, with at most a fifth of all pairs scored by full vectors."""
    queries, collection, found = found_by_cells(spark, sf_dir)
    recall = vectors.recall_at_k(found.top, rt.dense_topk(queries, collection, DEFAULT))
    itself = found.top.where("rank = 1").select("qid", (F.col("qid") == F.col("chunk_id")).alias("itself"))
    n = collection.count()
    per_query = recall.join(found.effort, "qid").join(itself, "qid")
    return per_query.agg(
        F.count("*").alias("n_queries"),
        F.lit(n).cast("long").alias("n_indexed"),
        (F.avg("recall") >= 0.9).alias("recall_reached"),
        (F.sum("scored") <= 0.2 * n * F.count("*")).alias("few_scored"),
        F.count_if("itself").alias("found_itself"),
    )


@query(
    """SELECT qid, rank, chunk_id, round(score, 6) AS score FROM (
      SELECT a.vec_id AS qid, b.vec_id AS chunk_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id)::INT AS rank
      FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE rank <= 10"""
)
def all_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's ten nearest others: the whole collection as one batch of queries."""
    collection = t.vector_collection(spark, sf_dir)
    queries = collection.withColumnRenamed("chunk_id", "qid")
    return rounded(vectors.exact_topk(queries, collection, DEFAULT.top_k, max_broadcast_queries=0, skip_same_id=True))


@query(
    """SELECT vec_id, d.text, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
    WHERE vec_id >= 0 ORDER BY vec_id LIMIT 100"""
)
def collection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows of the collection by key, two fields each; texts are fetched for those keys only."""
    from passagemill.operators.evaluation import collection_scan as scan

    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    keys = scan(t.table(spark, sf_dir, "embeddings").select("vec_id").join(docs.select("vec_id"), "vec_id"), "vec_id", [])
    return docs.join(F.broadcast(keys.distinct()), "vec_id")  # a hundred keys at most


# -- retrieval -----------------------------------------------------------


@query(f"WITH {t.LABEL_SEARCH} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rt.dense_topk(*search_inputs(spark, sf_dir), DEFAULT))


@query(f"WITH {t.LABEL_SEARCH} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 40")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rt.candidate_pool(*search_inputs(spark, sf_dir), DEFAULT))


@query(
    f"""WITH RECURSIVE {t.LABEL_SEARCH},
    pool AS (SELECT * FROM ranked WHERE rank <= 40),
    alike AS (SELECT a.qid, a.rank AS ra, b.rank AS rb, list_cosine_similarity(a.cv, b.cv) AS s FROM pool a JOIN pool b USING (qid)),
    walk(qid, step, pick, chosen) AS (
      SELECT qid, 1, 1, [1] FROM pool WHERE rank = 1
      UNION ALL
      SELECT qid, step + 1, pick, list_append(chosen, pick) FROM (
        SELECT w.qid, w.step, w.chosen, p.rank AS pick, row_number() OVER (PARTITION BY w.qid
          ORDER BY round(0.5 * p.score - 0.5 * max(s.s), 12) DESC, p.rank) AS n
        FROM walk w JOIN pool p ON p.qid = w.qid AND NOT list_contains(w.chosen, p.rank)
          JOIN alike s ON s.qid = w.qid AND s.ra = p.rank AND list_contains(w.chosen, s.rb)
        WHERE w.step < 10 GROUP BY w.qid, w.step, w.chosen, p.rank, p.score)
      WHERE n = 1)
    SELECT w.qid, w.step::INT AS rank, p.chunk_id, p.rank AS dense_rank, round(p.score, 6) AS score
    FROM walk w JOIN pool p ON p.qid = w.qid AND p.rank = w.pick"""
)
def mmr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rt.retrieve(*search_inputs(spark, sf_dir), RetrievalOptions(rerank_backend="mmr")))


REPLY_SQL = "'I rank ' || doc_id % 7 || ', ' || doc_id % 23 || ' then ' || doc_id || ' 99999999999999999999 ' || doc_id % 7"


@query(
    f"""WITH r AS (SELECT doc_id, 1 + doc_id % 12 AS n, list_transform(regexp_extract_all({REPLY_SQL}, '\\d+'),
        lambda d: try_cast(d AS BIGINT)) AS named FROM documents),
    u AS (SELECT doc_id, n, unnest(named) AS i, generate_subscripts(named, 1) AS k FROM r),
    good AS (SELECT doc_id, i - 1 AS i, min(k) AS k FROM u WHERE i BETWEEN 1 AND n GROUP BY doc_id, i),
    everyone AS (SELECT doc_id, unnest(range(n)) AS i FROM r)
    SELECT doc_id, string_agg(i, ',' ORDER BY coalesce(k, 1000), i) AS new_order
    FROM everyone LEFT JOIN good USING (doc_id, i) GROUP BY doc_id"""
)
def parse_rank_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply per document, with repeats, numbers out of range and one of twenty digits."""
    doc = F.col("doc_id")

    def num(c) -> F.Column:
        return c.cast("string")

    reply = F.concat(
        F.lit("I rank "), num(doc % 7), F.lit(", "), num(doc % 23), F.lit(" then "), num(doc),
        F.lit(" 99999999999999999999 "), num(doc % 7),
    )
    order = parse_order(reply, (doc % 12 + 1).cast("int"))
    return t.table(spark, sf_dir, "documents").select("doc_id", F.array_join(order.cast("array<string>"), ",").alias("new_order"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model reply per question; every fourth call failed."""
    item = F.col("item_id")
    text = F.concat(
        F.lit("passages ranked: "), (item % 45).cast("string"), F.lit(", "), (item % 11 + 1).cast("string"), F.lit(", 3, 3, 40")
    )
    return t.table(spark, sf_dir, "benchmark").select(item.alias("qid"), F.when(item % 4 != 0, text).alias("reply"))


RERANKED = f"""{t.QUESTION_SEARCH},
    pool AS (SELECT * FROM ranked WHERE rank <= 40),
    named AS (
      SELECT item_id AS qid, [item_id % 45, item_id % 11 + 1, 3, 40] AS picks FROM benchmark WHERE item_id % 4 <> 0),
    spread AS (SELECT qid, unnest(picks) AS rank, generate_subscripts(picks, 1) AS k FROM named),
    firsts AS (SELECT qid, rank, min(k) AS k FROM spread GROUP BY qid, rank),
    reordered AS (
      SELECT p.qid, p.chunk_id, p.rank AS dense_rank, p.score,
        row_number() OVER (PARTITION BY p.qid ORDER BY coalesce(f.k, 1000), p.rank)::INT AS new_rank
      FROM pool p LEFT JOIN firsts f ON f.qid = p.qid AND f.rank = p.rank)"""


@query(
    f"WITH {RERANKED} SELECT qid, new_rank AS rank, chunk_id, dense_rank, round(score, 6) AS score FROM reordered WHERE new_rank <= 10"
)
def listwise_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = RetrievalOptions(rerank_backend="llm")
    return rounded(rt.retrieve(*question_inputs(spark, sf_dir), options, replies(spark, sf_dir)))


@query(
    f"""WITH {t.QUESTION_SEARCH},
    shown AS (SELECT qid, rank, regexp_replace(trim(text, ' ' || chr(10)), '\\s+', ' ', 'g') AS flat
      FROM ranked JOIN documents ON doc_id = chunk_id WHERE rank <= 40)
    SELECT s.qid, {quoted(RERANK_HEAD)} || any_value(b.text) || {quoted(RERANK_PASSAGES)}
      || string_agg('[' || rank || '] ' || CASE WHEN length(flat) > 400 THEN left(flat, 400) || '…' ELSE flat END, chr(10) ORDER BY rank)
      || {quoted(RERANK_TAIL_A)} || '10' || {quoted(RERANK_TAIL_B)} AS prompt
    FROM shown s JOIN benchmark b ON b.item_id = s.qid GROUP BY s.qid"""
)
def rerank_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, collection = question_inputs(spark, sf_dir)
    pool = rt.candidate_pool(queries, collection, DEFAULT)
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    bound = rt.rows_bound(queries, DEFAULT.candidate_k, DEFAULT)
    return rt.rerank_prompts(rt.attach(pool, docs, ["text"], bound), queries, DEFAULT)


@query(
    f"""WITH {t.LABEL_SEARCH} SELECT mode, qid, rank, chunk_id, rank AS dense_rank, round(score, 6) AS score
    FROM ranked, (VALUES ('unknown backend'), ('no replies'), ('failed replies')) m(mode) WHERE rank <= 10"""
)
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown backend, a listwise run without replies, and one whose replies all failed."""
    queries, collection = search_inputs(spark, sf_dir)
    failed = queries.select("qid", F.lit(None).cast("string").alias("reply"))
    runs = {
        "unknown backend": rt.retrieve(queries, collection, RetrievalOptions(rerank_backend=" Cohere ")),
        "no replies": rt.retrieve(queries, collection, RetrievalOptions(rerank_backend="llm")),
        "failed replies": rt.retrieve(queries, collection, RetrievalOptions(rerank_backend="llm"), failed),
    }
    out = None
    for mode, ranked in runs.items():
        rows = rounded(ranked).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


# -- context and prompts -------------------------------------------------


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the fields a numbered source shows; some names and headers are empty."""
    doc = F.col("doc_id")
    return t.table(spark, sf_dir, "documents").select(
        doc.alias("chunk_id"),
        F.when(doc % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("name"),
        F.when(doc % 2 == 0, F.concat("source", F.lit(".pdf"))).alias("original_filename"),
        F.array("lang", F.lit(None).cast("string"), F.lit(""), F.concat(F.lit("Part "), doc.cast("string"))).alias("headers"),
        "text",
    )


SOURCE_SQL = """'[' || rank || '] ' || coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''),
      CASE WHEN doc_id % 2 = 0 THEN source || '.pdf' END, 'unknown') || ' › ' || lang || ' › Part ' || doc_id || chr(10) || text"""


def top_passages(spark: SparkSession, sf_dir: str, queries: DataFrame, collection: DataFrame) -> DataFrame:
    ranked = rt.dense_topk(queries, collection, DEFAULT)
    bound = rt.rows_bound(queries, DEFAULT.top_k, DEFAULT)
    return rt.attach(ranked, passages(spark, sf_dir), ["name", "original_filename", "headers", "text"], bound)


@query(
    f"WITH {t.LABEL_SEARCH} SELECT qid, rank, chunk_id, {SOURCE_SQL} AS source FROM ranked JOIN documents ON doc_id = chunk_id WHERE rank <= 10"
)
def format_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = top_passages(spark, sf_dir, *search_inputs(spark, sf_dir))
    return ctx.format_sources(wide).select("qid", "rank", "chunk_id", "source")


def contexts(spark: SparkSession, sf_dir: str, queries: DataFrame, collection: DataFrame) -> DataFrame:
    return ctx.build_context(queries, top_passages(spark, sf_dir, queries, collection))


@query(
    f"""WITH {t.LABEL_SEARCH}, found AS (
      SELECT qid, string_agg({SOURCE_SQL}, chr(10) || chr(10) ORDER BY rank) AS context
      FROM ranked JOIN documents ON doc_id = chunk_id WHERE rank <= 10 GROUP BY qid)
    SELECT qid, coalesce(context, {quoted(NO_RESULTS)}) AS context FROM label_queries LEFT JOIN found USING (qid)"""
)
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: per query vector, the ten best passages as one numbered context."""
    return contexts(spark, sf_dir, *search_inputs(spark, sf_dir))


@query(
    f"""WITH {t.TURNS}, latest AS (SELECT conversation_id, max(turn_id) AS pending_turn FROM turns GROUP BY ALL)
    SELECT conversation_id, turn_id, 0 AS part, 'human' AS type,
      {quoted(SYSTEM_RULES)} || '[1] turn ' || turn_id || chr(10) || chr(10) || 'Question: ' || question AS content
    FROM turns JOIN latest USING (conversation_id) WHERE turn_id = pending_turn
    UNION ALL
    SELECT conversation_id, turn_id, part, CASE part WHEN 0 THEN 'human' ELSE 'ai' END,
      CASE part WHEN 0 THEN question ELSE answer END
    FROM turns JOIN latest USING (conversation_id), (VALUES (0), (1)) p(part)
    WHERE turn_id < pending_turn AND status = 'complete'"""
)
def turn_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passagemill.operators.conversations import completed_turns

    turns = t.turns(spark, sf_dir)
    asked = turns.withColumn("context", F.concat(F.lit("[1] turn "), F.col("turn_id").cast("string")))
    return ctx.turn_prompts(asked, completed_turns(turns))


@query(
    f"""WITH {t.TURNS}, targets AS (
      SELECT * FROM turns WHERE status = 'cancel' OR turn_id = (SELECT max(o.turn_id) FROM turns o WHERE o.conversation_id = turns.conversation_id))
    SELECT conversation_id, turn_id AS target_turn, turn_id, 0 AS part, 'human' AS type,
      {quoted(SYSTEM_RULES)} || '[1] turn ' || turn_id || chr(10) || chr(10) || 'Question: ' || question AS content
    FROM targets
    UNION ALL
    SELECT t.conversation_id, g.turn_id AS target_turn, t.turn_id, part, CASE part WHEN 0 THEN 'human' ELSE 'ai' END,
      CASE part WHEN 0 THEN t.question ELSE t.answer END
    FROM turns t JOIN targets g ON g.conversation_id = t.conversation_id AND t.turn_id < g.turn_id, (VALUES (0), (1)) p(part)
    WHERE t.status = 'complete'"""
)
def open_turn_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of every cancelled turn, as if it were asked again, and of each conversation's last turn."""
    from passagemill.operators.conversations import completed_turns

    turns = t.turns(spark, sf_dir)
    last = turns.groupBy("conversation_id").agg(F.max("turn_id").alias("last"))
    targets = turns.join(last, "conversation_id").where("status = 'cancel' OR turn_id = last").drop("last")
    asked = targets.withColumn("context", F.concat(F.lit("[1] turn "), F.col("turn_id").cast("string")))
    return ctx.open_turn_prompts(asked, completed_turns(turns))
