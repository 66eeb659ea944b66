"""Recall and answer-quality evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import strip

# Sampling and snippet limits of the recall check.
SCAN_ROWS = 100
SAMPLE_ROWS = 10
MIN_TEXT = 200
SNIPPET_FROM = 50
SNIPPET_TO = 150
PASS_SCORE = 3
STRONG_SCORE = 4
BEYOND = "Beyond the sources:"
# (metric, comparison, target)
ACCEPTANCE = [
    ("retrieval_strong_rate", ">=", 0.80),
    ("generation_strong_rate", ">=", 0.75),
    ("empty_answers", "<=", 0.0),
    ("truncated_answers", "<=", 0.0),
    ("unsourced_answers", "<=", 0.0),
    ("docx_probe_rate", ">=", 0.80),
]


def collection_scan(collection: DataFrame, key: str, columns: list[str], limit: int = SCAN_ROWS) -> DataFrame:
    """The first ``limit`` rows by key, of the chosen columns only (a top-k report)."""
    return collection.where(F.col(key) >= 0).select(key, *columns).orderBy(key).limit(limit)


def eval_sample(
    collection: DataFrame,
    key: str = "pk",
    seed: int = 0,
    scan_rows: int = SCAN_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    min_text: int = MIN_TEXT,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """``sample_rows`` chunks longer than ``min_text`` characters from the first ``scan_rows``, in a seeded random order.

    Keys are chosen first, from lengths alone; texts are fetched for the sample only.
    ``lengths(key, length)`` names the rows to choose from where not all of ``collection`` count:
    a join before this one would move every text.
    """
    if lengths is None:
        lengths = collection.select(key, F.length("text").alias("length"))
    scanned = collection_scan(lengths, key, ["length"], scan_rows)
    draw = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    chosen = scanned.where(F.col("length") > min_text).orderBy(draw, key).limit(sample_rows)
    return collection.select(key, "text", "source").join(F.broadcast(chosen.select(key)), key)


def expected_snippet(text: Column) -> Column:
    return F.when(
        F.length(text) > SNIPPET_TO, F.substring(text, SNIPPET_FROM + 1, SNIPPET_TO - SNIPPET_FROM)
    ).otherwise(F.substring(text, 1, SNIPPET_FROM))


def recall_hits(items: DataFrame, contexts: DataFrame) -> DataFrame:
    """``items(qid, text, source, question)`` against ``contexts(qid, context)``.

    An item without a question is not asked and does not count.
    """
    snippet = expected_snippet(F.col("text"))
    return (
        items.where(F.col("question").isNotNull())
        .join(contexts, "qid", "left")
        .select(
            "qid",
            F.coalesce("source", F.lit("unknown")).alias("source"),
            "question",
            snippet.alias("expected_text_snippet"),
            F.coalesce(F.contains(F.col("context"), snippet), F.lit(False)).alias("hit"),
        )
    )


def exact_hits(items: DataFrame, ranked: DataFrame) -> DataFrame:
    """Whether the chunk an item came from is itself among the retrieved ones.

    Snippets inside a shared context line make the containment test generous; this
    one is not.
    """
    found = ranked.select("qid", F.col("chunk_id").alias("pk"), F.lit(True).alias("chunk_hit"))
    return (
        items.select("qid", "pk")
        .join(found, ["qid", "pk"], "left")
        .withColumn("chunk_hit", F.coalesce("chunk_hit", F.lit(False)))
    )


def recall_rate(hits: DataFrame) -> DataFrame:
    """``successful, total, recall_rate`` in percent; 0 for an empty run."""
    good = F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0))
    return hits.agg(
        good.alias("successful"),
        F.count("*").alias("total"),
        F.coalesce(F.try_divide(good * 100.0, F.count("*")), F.lit(0.0)).alias("recall_rate"),
    )


def qa_scorecard(probes: DataFrame) -> DataFrame:
    """Pass, strong and failure counts of scored probes."""

    def count(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)

    return probes.agg(
        F.count("*").alias("probes"),
        count(F.col("retrieval") >= PASS_SCORE, "retrieval_pass"),
        count(F.col("retrieval") >= STRONG_SCORE, "retrieval_strong"),
        count(F.col("generation") >= PASS_SCORE, "generation_pass"),
        count(F.col("generation") >= STRONG_SCORE, "generation_strong"),
        count(F.col("generation") == 0, "hard_failures"),
    )


def docx_probe_rate(probes: DataFrame, winners: DataFrame) -> DataFrame:
    """``(metric, value)``: of the probes about Word files, the share that retrieved a chunk of one.

    ``probes(qid)`` are those probes, ``winners(qid, source_ext)`` what was retrieved for any probe.
    """
    of_word = winners.where(F.lower("source_ext") == ".docx").select("qid").distinct().withColumn("met", F.lit(1.0))
    met = probes.select("qid").join(of_word, "qid", "left")
    return met.agg(F.avg(F.coalesce("met", F.lit(0.0))).alias("value")).select(F.lit("docx_probe_rate").alias("metric"), "value")


def qa_acceptance(metrics: DataFrame) -> DataFrame:
    """``metrics(metric, value)`` against the fixed thresholds; a metric not measured fails."""
    spark = metrics.sparkSession
    rules = spark.createDataFrame(ACCEPTANCE, "metric string, op string, target double")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return rules.join(metrics, "metric", "left").select(
        "metric", "op", "target", "value", F.coalesce(ok, F.lit(False)).alias("accepted")
    )


def answer_checks(answers: DataFrame, output_cap: int = 8192) -> DataFrame:
    """Flags per answer from ``(conversation_id, turn_id, answer, output_tokens_used, n_sources)``."""
    body = strip(F.col("answer"))
    cited = F.transform(
        F.regexp_extract_all(F.col("answer"), F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda d: d.try_cast("int")
    )
    outside = F.exists(cited, lambda i: i.isNull() | (i < 1) | (i > F.col("n_sources")))
    ends = body.rlike(r"""[.!?。！？…:;)\]"'”]\z""")
    return answers.select(
        "conversation_id",
        "turn_id",
        (body == "").alias("empty"),
        ((body != "") & ~ends & (F.col("output_tokens_used") >= output_cap)).alias("truncated"),
        F.col("answer").rlike(rf"(?m)^{BEYOND}").alias("beyond_sources"),
        outside.alias("bad_citation"),
    )
