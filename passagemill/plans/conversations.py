"""Conversation queries: events, history, sessions, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators import conversations as cv
from passagemill.plans import tables as t
from passagemill.plans.registry import query
from passagemill.sources.sinks import scratch_dir
from passagemill.streaming import events as live

FOLDED = f"""WITH {t.TURNS} SELECT conversation_id, turn_id, '[1] turn ' || turn_id AS context, question || ' ' AS reasoning,
      answer || ' ' AS answer, status, len(string_split(question, ' '))::INT AS input_tokens_used,
      len(string_split(answer, ' '))::INT AS output_tokens_used"""


@query(f"{FOLDED}, CASE WHEN status = 'complete' THEN left(question, 60) END AS title FROM turns")
def fold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.fold_events(t.events(spark, sf_dir)).select(
        "conversation_id", "turn_id", "context", "reasoning", "answer", "status",
        "metadata.input_tokens_used", "metadata.output_tokens_used", "metadata.title",
    )


@query(f"{FOLDED} FROM turns")
def fold_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold over a stream of newline-delimited JSON."""
    source, target = scratch_dir(spark, "events"), scratch_dir(spark, "folded")
    t.events(spark, sf_dir).write.json(source)
    folded = live.fold_event_stream(live.read_events(spark, source))
    live.run_to_table(folded, target, scratch_dir(spark, "events-progress"))
    return spark.read.parquet(target)


@query(
    f"""WITH {t.TURNS} SELECT conversation_id, turn_id, part, CASE part WHEN 0 THEN 'human' ELSE 'ai' END AS kind,
      CASE part WHEN 0 THEN question ELSE answer END AS content
    FROM turns, (VALUES (0), (1)) p(part) WHERE status = 'complete'"""
)
def completed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.completed_history(t.turns(spark, sf_dir))


TITLES = f"""{t.TURNS}, titles AS (
      SELECT conversation_id, coalesce(arg_min(title, turn_id) FILTER (status = 'complete' AND title NOT IN ('', 'New Chat')), 'New Chat') AS title
      FROM (SELECT *, left(trim(question, ' ' || chr(10)), 60) AS title FROM turns) GROUP BY ALL)"""


@query(
    f"""WITH {TITLES}, {t.SESSIONS} SELECT conversation_id, coalesce(title, 'New Chat') AS title,
      strftime(make_timestamp(epoch * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at
    FROM sessions LEFT JOIN titles USING (conversation_id)"""
)
def list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.list_sessions(t.sessions(spark, sf_dir), cv.session_titles(t.turns(spark, sf_dir)))


@query(
    """SELECT conv_id::VARCHAR AS conversation_id, turn AS turn_id, 0 AS part,
      CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'unknown' END AS role,
      CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE 'unknown' END AS type, text AS content FROM conversations"""
)
def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored message by role; system rows are of no known kind."""
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    messages = t.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("turn").alias("turn_id"),
        F.lit(0).alias("part"),
        kind.alias("kind"),
        F.col("text").alias("content"),
    )
    return cv.present_history(messages)


def cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that hold a system row are asked to be cleared."""
    rows = t.table(spark, sf_dir, "conversations").where(F.col("role") == "system")
    return rows.select(F.col("conv_id").cast("string").alias("conversation_id"))


@query(
    f"""WITH {t.TURNS} SELECT conversation_id, turn_id, status FROM turns
    WHERE conversation_id NOT IN (SELECT conv_id::VARCHAR FROM conversations WHERE role = 'system')"""
)
def clear_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = cv.clear_sessions(t.turns(spark, sf_dir), cleared(spark, sf_dir))
    return left.select("conversation_id", "turn_id", "status")


@query(
    f"""WITH {t.TURNS} SELECT conversation_id, turn_id, length(question) AS input_tokens_used,
      list_sum(list_transform(string_split(answer, chr(10)), lambda l: len(string_split(l, ' '))))::BIGINT AS output_tokens_used FROM turns"""
)
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage reported with every answer line: the prompt once, each line's words."""
    line = t.turns(spark, sf_dir).select(
        "conversation_id", "turn_id", "question", F.posexplode(F.split("answer", "\n")).alias("at", "line")
    )
    usage = line.select(
        "conversation_id",
        "turn_id",
        F.when(F.col("at") == 0, F.length("question")).otherwise(0).alias("input_tokens"),
        F.size(F.split("line", " ")).alias("output_tokens"),
    )
    return cv.token_usage(usage)


@query(f"WITH {TITLES} SELECT * FROM titles")
def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.session_titles(t.turns(spark, sf_dir))
