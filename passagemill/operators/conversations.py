"""Chat events, history, sessions and token usage.

``events`` follow ``schemas.CHAT_EVENT``; ``turns`` hold
``(conversation_id, turn_id, question, answer, status, created_at?)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.prompts import NEW_CHAT
from passagemill.functions.text import strip

# Event types and statuses on the wire.
RETRIEVE = "retrieve"
REASONING = "response.reasoning.delta"
ANSWER = "response.output_text.delta"
CALL = "response.function_call_arguments.delta"
COMPLETE = "complete"
CANCEL = "cancel"
TITLE_CHARS = 60
ROLES = {"human": ("user", "human"), "ai": ("assistant", "ai")}

TURN = ["conversation_id", "turn_id"]


def _deltas(kind: str) -> Column:
    rows = F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("seq", "content"))))
    return F.array_join(F.transform(rows, lambda r: r["content"]), "")


def fold_events(events: DataFrame) -> DataFrame:
    """One row per turn: context, reasoning, answer and closing metadata.

    The last ``retrieve`` event wins, deltas are joined in ``seq`` order.  A group
    is one turn, whose text is bounded by the model's output limit.
    """
    closing = F.col("status").isin(COMPLETE, CANCEL) & ~F.col("type").isin(RETRIEVE, REASONING, ANSWER)
    last = F.max_by(F.struct("status", "metadata"), F.when(closing, F.col("seq")))
    return (
        events.groupBy(*TURN)
        .agg(
            F.max_by("content", F.when(F.col("type") == RETRIEVE, F.col("seq"))).alias("context"),
            _deltas(REASONING).alias("reasoning"),
            _deltas(ANSWER).alias("answer"),
            F.when(F.max(closing), last).alias("_last"),
        )
        .select(
            *TURN,
            F.coalesce("context", F.lit("")).alias("context"),
            "reasoning",
            "answer",
            F.col("_last.status").alias("status"),
            F.col("_last.metadata").alias("metadata"),
        )
    )


def completed_turns(turns: DataFrame) -> DataFrame:
    """Only a completed turn enters the history; a cancelled one leaves nothing."""
    return turns.where(F.col("status") == COMPLETE)


def completed_history(turns: DataFrame) -> DataFrame:
    """Message rows ``(conversation_id, turn_id, part, kind, content)`` of completed turns."""
    messages = F.explode(
        F.array(
            F.struct(F.lit(0).alias("part"), F.lit("human").alias("kind"), F.col("question").alias("content")),
            F.struct(F.lit(1).alias("part"), F.lit("ai").alias("kind"), F.col("answer").alias("content")),
        )
    )
    return completed_turns(turns).select(*TURN, messages.alias("m")).select(*TURN, "m.part", "m.kind", "m.content")


def present_history(messages: DataFrame, for_display: bool = False) -> DataFrame:
    """Messages as ``role, type, content``; unknown kinds stay visible unless ``for_display``."""
    role, kind = F.lit("unknown"), F.lit("unknown")
    for name, (as_role, as_type) in ROLES.items():
        role = F.when(F.col("kind") == name, as_role).otherwise(role)
        kind = F.when(F.col("kind") == name, as_type).otherwise(kind)
    out = messages.select(*TURN, "part", role.alias("role"), kind.alias("type"), "content")
    return out.where(F.col("role").isin("user", "assistant")) if for_display else out


def iso_utc(ts: Column) -> Column:
    """ISO 8601 in UTC, whatever the session's time zone; fractional seconds only when there are any."""
    day, micros = 86_400_000_000, F.unix_micros(ts)
    since = F.make_dt_interval(
        F.floor(micros / day).cast("int"), F.lit(0), F.lit(0), (F.pmod(micros, F.lit(day)).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    )
    local = F.lit("1970-01-01").cast("timestamp_ntz") + since
    part = F.pmod(micros, F.lit(1_000_000))
    return F.concat(
        F.replace(F.substring(local.cast("string"), 1, 19), F.lit(" "), F.lit("T")),
        F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))),
        F.lit("+00:00"),
    )


def session_titles(turns: DataFrame) -> DataFrame:
    """Title per conversation: the first completed question that yields a real title."""
    title = F.substring(strip(F.col("question")), 1, TITLE_CHARS)
    usable = (F.col("status") == COMPLETE) & (title != "") & (title != NEW_CHAT)
    return turns.groupBy("conversation_id").agg(
        F.coalesce(F.min_by(title, F.when(usable, F.col("turn_id"))), F.lit(NEW_CHAT)).alias("title")
    )


def list_sessions(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Sessions newest first; one that has no turn yet is a new chat."""
    return (
        sessions.join(titles, "conversation_id", "left")
        .orderBy(F.desc("created_at"), "conversation_id")
        .select(
            "conversation_id",
            F.coalesce("title", F.lit(NEW_CHAT)).alias("title"),
            iso_utc(F.col("created_at")).alias("created_at"),
        )
    )


def clear_sessions(turns: DataFrame, cleared: DataFrame) -> DataFrame:
    """The store without the cleared conversations."""
    return turns.join(cleared.select("conversation_id").distinct(), "conversation_id", "left_anti")


def clear_report(sessions: DataFrame, cleared: DataFrame) -> DataFrame:
    """For every conversation asked to be cleared: did it exist?"""
    known = sessions.select("conversation_id", F.lit(True).alias("existed")).distinct()
    return (
        cleared.select("conversation_id")
        .distinct()
        .join(known, "conversation_id", "left")
        .withColumn("existed", F.coalesce("existed", F.lit(False)))
    )


def token_usage(usage: DataFrame) -> DataFrame:
    """Input and output tokens per turn from the usage reported along the stream."""
    return usage.groupBy(*TURN).agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens_used"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens_used"),
    )
