"""Numbered contexts and turn prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.prompts import NO_RESULTS, format_source, turn_message


def format_sources(ranked: DataFrame) -> DataFrame:
    """``ranked(qid, rank, name, original_filename, headers, text)`` with a ``source`` text each."""
    return ranked.withColumn(
        "source",
        format_source(F.col("rank"), F.col("name"), F.col("original_filename"), F.col("headers"), F.col("text")),
    )


def build_context(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(qid, context)`` for every query; without passages a fixed sentence."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "source")))
    contexts = (
        format_sources(ranked)
        .groupBy("qid")
        .agg(F.array_join(F.transform(rows, lambda r: r["source"]), "\n\n").alias("context"))
    )
    return queries.select("qid").join(contexts, "qid", "left").withColumn(
        "context", F.coalesce("context", F.lit(NO_RESULTS))
    )


def turn_prompts(turns: DataFrame, history: DataFrame) -> DataFrame:
    """Messages of each conversation's latest turn, one row per message.

    ``turns(conversation_id, turn_id, question, context)``; ``history`` holds the
    completed turns ``(conversation_id, turn_id, question, answer)``.  Only the
    latest turn is still to be answered, so every history message is written once
    and the output grows with the conversation, not with its square.  History is
    the raw question and answer, without the old context.

    Both joins are on (conversation, turn), so one very long conversation is spread
    like any other rows; messages are ordered by ``turn_id, part``.
    """
    key = ["conversation_id", "turn_id"]
    latest = turns.groupBy("conversation_id").agg(F.max("turn_id").alias("turn_id"))
    asked = turns.join(latest, key, "left_semi").select(
        *key,
        F.lit(0).alias("part"),
        F.lit("human").alias("type"),
        turn_message(F.col("context"), F.col("question")).alias("content"),
    )
    messages = F.explode(
        F.array(
            F.struct(F.lit(0).alias("part"), F.lit("human").alias("type"), F.col("question").alias("content")),
            F.struct(F.lit(1).alias("part"), F.lit("ai").alias("type"), F.col("answer").alias("content")),
        )
    )
    earlier = (
        history.join(latest, key, "left_anti")
        .select(*key, messages.alias("m"))
        .select(*key, "m.part", "m.type", "m.content")
    )
    return earlier.unionByName(asked)


def open_turn_prompts(targets: DataFrame, history: DataFrame, texts: bool = True) -> DataFrame:
    """Messages of any turns still to be answered: ``(conversation_id, target_turn, turn_id, part, type[, content])``.

    ``targets(conversation_id, turn_id, question, context)`` may list several turns of a
    conversation, the middle ones too; each sees the completed turns of ``history`` before
    it.  Without ``texts`` only places are given, to be joined to one copy of the messages.
    """
    asked = targets.select(
        "conversation_id",
        F.col("turn_id").alias("target_turn"),
        "turn_id",
        F.lit(0).alias("part"),
        F.lit("human").alias("type"),
        turn_message(F.col("context"), F.col("question")).alias("content"),
    )
    said = history.select("conversation_id", "turn_id", *(["question", "answer"] if texts else []))
    seen = targets.select("conversation_id", F.col("turn_id").alias("target_turn")).join(said, "conversation_id").where("turn_id < target_turn")
    content = [F.col("question").alias("content")], [F.col("answer").alias("content")]
    messages = F.explode(
        F.array(
            F.struct(F.lit(0).alias("part"), F.lit("human").alias("type"), *(content[0] if texts else [])),
            F.struct(F.lit(1).alias("part"), F.lit("ai").alias("type"), *(content[1] if texts else [])),
        )
    )
    earlier = seen.select("conversation_id", "target_turn", "turn_id", messages.alias("m")).select(
        "conversation_id", "target_turn", "turn_id", "m.*"
    )
    return earlier.unionByName(asked if texts else asked.drop("content"))
