"""Evaluation queries: recall, QA scorecard, acceptance and answer checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill import jobs
from passagemill.functions.embed import embed_hashed
from passagemill.functions.prompts import QUESTION_HEAD, QUESTION_TAIL
from passagemill.functions import paths
from passagemill.operators import evaluation as ev
from passagemill.operators import retrieval as rt
from passagemill.options import RetrievalOptions
from passagemill.plans import tables as t
from passagemill.plans.registry import query
from passagemill.plans.retrieval import SOURCE_SQL, contexts, passages, question_inputs
from passagemill.sources.sinks import scratch_dir


@query(
    """SELECT doc_id AS pk, text, source FROM (SELECT * FROM documents WHERE doc_id >= 0 ORDER BY doc_id LIMIT 100)
    WHERE length(text) > 200 ORDER BY md5(doc_id || ':0'), doc_id LIMIT 10"""
)
def eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), "text", "source")
    return ev.eval_sample(docs)


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as evaluation chunks, asked about by their own text; some questions failed."""
    item = F.col("item_id")
    return t.table(spark, sf_dir, "benchmark").select(
        item.alias("qid"),
        "text",
        F.when(item % 2 == 0, F.lit("benchmark")).alias("source"),
        F.when(item % 9 != 0, F.col("text")).alias("question"),
    )


HITS = f"""{t.QUESTION_SEARCH}, found AS (
      SELECT qid, string_agg({SOURCE_SQL}, chr(10) || chr(10) ORDER BY rank) AS context
      FROM ranked JOIN documents ON doc_id = chunk_id WHERE rank <= 10 GROUP BY qid),
    hits AS (
      SELECT qid, CASE WHEN qid % 2 = 0 THEN 'benchmark' ELSE 'unknown' END AS source, text AS question, snip AS expected_text_snippet,
        coalesce(contains(context, snip), false) AS hit
      FROM (SELECT item_id AS qid, text, CASE WHEN length(text) > 150 THEN substr(text, 51, 100) ELSE left(text, 50) END AS snip
        FROM benchmark WHERE item_id % 9 <> 0) LEFT JOIN found USING (qid))"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contexts(spark, sf_dir, *question_inputs(spark, sf_dir))
    return ev.recall_hits(eval_items(spark, sf_dir), found)


@query(f"WITH {HITS} SELECT * FROM hits")
def recall_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir)


@query(
    f"""WITH {HITS} SELECT count(*) FILTER (hit) AS successful, count(*) AS total,
      round(coalesce(100.0 * count(*) FILTER (hit) / nullif(count(*), 0), 0)::DOUBLE, 6) AS recall_rate FROM hits"""
)
def recall_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.recall_rate(hits(spark, sf_dir)).withColumn("recall_rate", F.round("recall_rate", 6))


@query(
    f"""WITH col AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS v, d.* FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
    sample AS (SELECT * FROM (SELECT * FROM col ORDER BY vec_id LIMIT 100) WHERE length(text) > 200 ORDER BY md5(vec_id || ':0'), vec_id LIMIT 10),
    asked AS (SELECT vec_id AS qid, list_concat(v[1:8], [0.0::DOUBLE FOR x IN range(56)]) AS q FROM sample),
    ranked AS (SELECT qid, c.*, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q, v), 12) DESC, vec_id)::INT AS rank
      FROM asked, col c),
    found AS (SELECT qid, string_agg({SOURCE_SQL}, chr(10) || chr(10) ORDER BY rank) AS context FROM ranked WHERE rank <= 10 GROUP BY qid)
    SELECT qid, source, left(text, 80) AS question, snip AS expected_text_snippet, contains(context, snip) AS hit
    FROM (SELECT vec_id AS qid, source, text, CASE WHEN length(text) > 150 THEN substr(text, 51, 100) ELSE left(text, 50) END AS snip
      FROM sample) JOIN found USING (qid)"""
)
def recall_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled chunks looked up by the first eight of their sixty-four dimensions."""
    vectors = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), "text", "source")
    # Only ids, lengths and vectors are shuffled; texts are scanned for the rows that were chosen.
    lengths = docs.select("pk", F.length("text").alias("length")).join(vectors.select(F.col("chunk_id").alias("pk")), "pk")
    collection = vectors.join(docs.select(F.col("pk").alias("chunk_id")), "chunk_id")
    chosen = scratch_dir(spark, "recall-sample")
    ev.eval_sample(docs, lengths=lengths).write.parquet(chosen)  # ten rows, read by each step of the run
    sample = spark.read.parquet(chosen)

    def found(asked: DataFrame) -> DataFrame:
        dims = F.concat(F.slice("embedding", 1, 8), F.array_repeat(F.lit(0.0).cast("float"), 56))
        queries = asked.join(vectors.select(F.col("chunk_id").alias("qid"), dims.alias("embedding")), "qid")
        return jobs.contexts(queries, collection, sources=passages(spark, sf_dir))

    details, _ = jobs.recall_evaluation(sample, sample.select("pk", F.substring("text", 1, 80).alias("question")), found)
    return details


WORDS_ASKED = 12


def question_writer():
    """A stand-in for a chat model: asks with the first words of the text; fails for some texts, for others at the first try."""
    tries: dict[str, int] = {}

    def ask(prompt: str) -> str:
        text = prompt[len(QUESTION_HEAD) : len(prompt) - len(QUESTION_TAIL)]
        tries[text] = tries.get(text, 0) + 1
        if len(text) % 5 == 0:
            raise RuntimeError("no answer")
        if len(text) % 3 == 0 and tries[text] == 1:
            raise TimeoutError("too slow")
        return " ".join(text.split(" ")[:WORDS_ASKED])

    return ask


ASKED = f"""sample AS (
      SELECT doc_id AS pk, text, source FROM (SELECT * FROM documents WHERE doc_id >= 0 ORDER BY doc_id LIMIT 100)
      WHERE length(text) > 200 ORDER BY md5(doc_id || ':0'), doc_id LIMIT 10),
    asked AS (SELECT pk, text, source, array_to_string(string_split(text, ' ')[1:{WORDS_ASKED}], ' ') AS question FROM sample WHERE length(text) % 5 <> 0),
    {t.word_counts_sql("dv", "documents", "doc_id", "text")},
    {t.word_counts_sql("qv", "asked", "pk", "question")},
    scored AS (SELECT q.id AS qid, d.id AS chunk_id, list_cosine_similarity(q.v, d.v) AS score FROM qv q, dv d),
    ranked AS (
      SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id)::INT AS rank FROM scored),
    found AS (
      SELECT qid, string_agg({SOURCE_SQL}, chr(10) || chr(10) ORDER BY rank) AS context
      FROM ranked JOIN documents ON doc_id = chunk_id WHERE rank <= 10 GROUP BY qid),
    hits AS (
      SELECT pk, question, contains(context, CASE WHEN length(text) > 150 THEN substr(text, 51, 100) ELSE left(text, 50) END) AS hit
      FROM asked JOIN found ON qid = pk)"""


@query(
    f"""WITH {ASKED} SELECT 'asked' AS kind, pk, question, hit, NULL::VARCHAR AS failure, NULL::BIGINT AS successful, NULL::BIGINT AS total, NULL::DOUBLE AS recall_rate FROM hits
    UNION ALL SELECT 'failed', pk, NULL, NULL, 'RuntimeError: no answer', NULL, NULL, NULL FROM sample WHERE length(text) % 5 = 0
    UNION ALL SELECT 'run', NULL, NULL, NULL, NULL, count(*) FILTER (hit), count(*), round(coalesce(100.0 * count(*) FILTER (hit) / nullif(count(*), 0), 0)::DOUBLE, 6) FROM hits"""
)
def generated_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks are sampled, a model asks about them, its questions are embedded and looked up among all documents."""
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), "text", "source")
    collection = t.document_collection(spark, sf_dir)

    def found(asked: DataFrame) -> DataFrame:
        return contexts(spark, sf_dir, embed_hashed(asked, "question"), collection)

    details, summary, failures = jobs.generated_recall(ev.eval_sample(docs), question_writer, found, wait_s=0.0)
    rows = [
        details.select(F.lit("asked").alias("kind"), F.col("qid").alias("pk"), "question", "hit"),
        failures.select(F.lit("failed").alias("kind"), "pk", "failure"),
        summary.select(F.lit("run").alias("kind"), "successful", "total", F.round("recall_rate", 6).alias("recall_rate")),
    ]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return whole.select("kind", "pk", "question", "hit", "failure", "successful", "total", "recall_rate")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored probes."""
    doc = F.col("doc_id")
    return t.table(spark, sf_dir, "labels").select(
        doc.alias("id"),
        ((doc + 2 * F.col("quality")) % 6).cast("int").alias("retrieval"),
        ((doc * 5 + F.col("toxic")) % 6).cast("int").alias("generation"),
    )


SCORECARD = """card AS (
      SELECT count(*) AS probes, count(*) FILTER (r >= 3) AS retrieval_pass, count(*) FILTER (r >= 4) AS retrieval_strong,
        count(*) FILTER (g >= 3) AS generation_pass, count(*) FILTER (g >= 4) AS generation_strong, count(*) FILTER (g = 0) AS hard_failures
      FROM (SELECT (doc_id + 2 * quality) % 6 AS r, (doc_id * 5 + toxic) % 6 AS g FROM labels))"""


@query(f"WITH {SCORECARD} SELECT * FROM card")
def qa_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.qa_scorecard(probes(spark, sf_dir))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with citations, unsourced endings, cut ends and blank texts put in."""
    turn, text = F.col("turn_id"), F.col("answer")
    return t.turns(spark, sf_dir).select(
        "conversation_id",
        "turn_id",
        F.when(turn % 4 == 1, F.concat(text, F.lit(" [2] and [12]")))
        .when(turn % 4 == 2, F.concat(text, F.lit(" [1]\nBeyond the sources: more.")))
        .when(F.length("question") % 5 == 0, F.concat(text, F.lit(" and then")))
        .when(F.length("question") % 5 == 1, F.lit(" \n "))
        .otherwise(text)
        .alias("answer"),
        F.when(F.length("question") % 2 == 0, 8192).otherwise(100).alias("output_tokens_used"),
        F.lit(10).alias("n_sources"),
    )


CHECKS = (
    t.TURNS
    + r""", answers AS (
      SELECT conversation_id, turn_id, CASE WHEN turn_id % 4 = 1 THEN answer || ' [2] and [12]'
          WHEN turn_id % 4 = 2 THEN answer || ' [1]' || chr(10) || 'Beyond the sources: more.'
          WHEN length(question) % 5 = 0 THEN answer || ' and then' WHEN length(question) % 5 = 1 THEN ' ' || chr(10) || ' '
          ELSE answer END AS answer,
        CASE WHEN length(question) % 2 = 0 THEN 8192 ELSE 100 END AS tokens FROM turns),
    checks AS (
      SELECT conversation_id, turn_id, body = '' AS empty,
        body <> '' AND NOT regexp_matches(body, '[.!?。！？…:;)\]"''”]$') AND tokens >= 8192 AS truncated,
        regexp_matches(answer, '(^|\n)Beyond the sources:') AS beyond_sources,
        len(list_filter(regexp_extract_all(answer, '\[([0-9]+)\]', 1), lambda d: d::INT < 1 OR d::INT > 10)) > 0 AS bad_citation
      FROM (SELECT *, trim(answer, ' ' || chr(10)) AS body FROM answers))"""
)


@query(f"WITH {CHECKS} SELECT * FROM checks")
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.answer_checks(answers(spark, sf_dir))


@query(
    f"""WITH {SCORECARD}, {CHECKS}, m(metric, value) AS (
      SELECT 'retrieval_strong_rate', (retrieval_strong / probes)::DOUBLE FROM card
      UNION ALL SELECT 'generation_strong_rate', (generation_strong / probes)::DOUBLE FROM card
      UNION ALL SELECT 'empty_answers', count(*) FILTER (empty)::DOUBLE FROM checks
      UNION ALL SELECT 'truncated_answers', count(*) FILTER (truncated)::DOUBLE FROM checks
      UNION ALL SELECT 'unsourced_answers', count(*) FILTER (beyond_sources)::DOUBLE FROM checks)
    SELECT metric, op, target::DOUBLE AS target, round(value, 6) AS value,
      coalesce(CASE op WHEN '>=' THEN value >= target ELSE value <= target END, false) AS accepted
    FROM (VALUES ('retrieval_strong_rate', '>=', 0.8), ('generation_strong_rate', '>=', 0.75), ('empty_answers', '<=', 0),
      ('truncated_answers', '<=', 0), ('unsourced_answers', '<=', 0), ('docx_probe_rate', '>=', 0.8)) r(metric, op, target)
    LEFT JOIN m USING (metric)"""
)
def qa_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of scored probes and answers against the thresholds; the docx rate needs a search (``qa_acceptance_docx``)."""
    accepted = ev.qa_acceptance(measured(spark, sf_dir))
    return accepted.withColumn("value", F.round("value", 6))


@query(
    f"""WITH {SCORECARD}, {CHECKS}, {t.QUESTION_SEARCH}, m(metric, value) AS (
      SELECT 'retrieval_strong_rate', (retrieval_strong / probes)::DOUBLE FROM card
      UNION ALL SELECT 'generation_strong_rate', (generation_strong / probes)::DOUBLE FROM card
      UNION ALL SELECT 'empty_answers', count(*) FILTER (empty)::DOUBLE FROM checks
      UNION ALL SELECT 'truncated_answers', count(*) FILTER (truncated)::DOUBLE FROM checks
      UNION ALL SELECT 'unsourced_answers', count(*) FILTER (beyond_sources)::DOUBLE FROM checks
      UNION ALL SELECT 'docx_probe_rate', avg(met::INT)::DOUBLE FROM (
        SELECT qid, bool_or(chunk_id % 6 = 3) AS met FROM ranked WHERE rank <= 10 AND qid % 3 = 0 GROUP BY qid))
    SELECT metric, op, target::DOUBLE AS target, round(value, 6) AS value,
      coalesce(CASE op WHEN '>=' THEN value >= target ELSE value <= target END, false) AS accepted
    FROM (VALUES ('retrieval_strong_rate', '>=', 0.8), ('generation_strong_rate', '>=', 0.75), ('empty_answers', '<=', 0),
      ('truncated_answers', '<=', 0), ('unsourced_answers', '<=', 0), ('docx_probe_rate', '>=', 0.8)) r(metric, op, target)
    LEFT JOIN m USING (metric)"""
)
def qa_acceptance_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thresholds; each third benchmark question is a probe about Word files, each sixth document one of them."""
    queries, collection = question_inputs(spark, sf_dir)
    ext = t.files(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), paths.extension(F.col("path")).alias("source_ext"))
    probes_ = queries.where("qid % 3 = 0")
    winners = rt.dense_topk(probes_, collection, RetrievalOptions()).select("qid", "chunk_id").join(ext, "chunk_id")
    docx = ev.docx_probe_rate(probes_, winners)
    accepted = ev.qa_acceptance(measured(spark, sf_dir).unionByName(docx))
    return accepted.withColumn("value", F.round("value", 6))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(metric, value)`` of scored probes and answers."""
    card = ev.qa_scorecard(probes(spark, sf_dir))
    checks = ev.answer_checks(answers(spark, sf_dir)).agg(
        *[F.sum(F.col(c).cast("double")).alias(c) for c in ("empty", "truncated", "beyond_sources")]
    )

    def metric(df: DataFrame, name: str, value) -> DataFrame:
        return df.select(F.lit(name).alias("metric"), value.cast("double").alias("value"))

    rows = [
        metric(card, "retrieval_strong_rate", F.try_divide("retrieval_strong", "probes")),
        metric(card, "generation_strong_rate", F.try_divide("generation_strong", "probes")),
        metric(checks, "empty_answers", F.col("empty")),
        metric(checks, "truncated_answers", F.col("truncated")),
        metric(checks, "unsourced_answers", F.col("beyond_sources")),
    ]
    return reduce(DataFrame.unionByName, rows)
