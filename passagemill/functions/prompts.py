"""Prompt, source and reply expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt texts that must equal the ones users run today.
RERANK_HEAD = (
    "You rank retrieved passages by how well each one helps answer a question.\n\nQuestion: "
)
RERANK_PASSAGES = "\n\nPassages:\n"
RERANK_TAIL_A = (
    "\n\nReturn the passage numbers ordered from most to least relevant (most relevant\n"
    'first) as a comma-separated list, e.g. "3, 1, 5". List only the '
)
RERANK_TAIL_B = " most\nrelevant numbers and output nothing but the numbers."
SYSTEM_RULES = (
    "You are an assistant for engineering standards and internal reference material. "
    "Answer the user's question using the numbered sources below.\n"
    "\n"
    "Rules:\n"
    "- Base every claim on the sources and cite them inline as [1], [2], etc.\n"
    "- If the sources do not contain the information needed, say so and name what is missing"
    " — do not guess or invent code requirements.\n"
    "- If you supplement with general knowledge, put it after the grounded answer under a line"
    ' reading "Beyond the sources:" so the user can tell them apart.\n'
    "\n"
    "Sources:\n"
)
QUESTION_HEAD = (
    "You are an expert evaluator. Generate a short, specific question that can be answered SOLELY by the "
    "following text. Do not provide the answer, just the question.\n\nText: "
)
QUESTION_TAIL = "\n\nQuestion:"
NO_RESULTS = "No relevant documents found in the knowledge base."
NEW_CHAT = "New Chat"
HEADER_JOIN = " › "


def rerank_prompt(query: Column, listing: Column, top_k: int) -> Column:
    return F.concat(
        F.lit(RERANK_HEAD), query, F.lit(RERANK_PASSAGES), listing,
        F.lit(RERANK_TAIL_A), F.lit(str(top_k)), F.lit(RERANK_TAIL_B),
    )


def turn_message(context: Column, question: Column) -> Column:
    return F.concat(F.lit(SYSTEM_RULES), context, F.lit("\n\nQuestion: "), question)


def question_prompt(text: Column) -> Column:
    """Asks a model for a question about one evaluation chunk."""
    return F.concat(F.lit(QUESTION_HEAD), text, F.lit(QUESTION_TAIL))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def source_name(name: Column, original: Column) -> Column:
    return F.coalesce(blank_to_null(name), blank_to_null(original), F.lit("unknown"))


def format_source(index: Column, name: Column, original: Column, headers: Column, text: Column) -> Column:
    """``[n] name › header path`` and the passage on the next line."""
    path = F.filter(F.coalesce(headers, F.array().cast("array<string>")), lambda h: h.isNotNull() & (h != ""))
    title = F.array_join(F.concat(F.array(source_name(name, original)), path), HEADER_JOIN)
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), title, F.lit("\n"), text)


# Decimal digits of other scripts and the ones they stand for.
_OTHER_DIGITS = tuple(
    "".join(part)
    for part in zip(
        *((c, str(unicodedata.decimal(c))) for c in map(chr, range(128, 0x20000)) if unicodedata.category(c) == "Nd")
    )
)


def parse_order(reply: Column, n: Column) -> Column:
    """A ranking reply as a full 0-based permutation of ``n`` passages.

    Numbers outside 1..n (however long) are ignored, repeats keep their first
    place, and what the reply leaves out follows in dense order.
    """
    plain = F.translate(F.coalesce(reply, F.lit("")), *_OTHER_DIGITS)
    named = F.transform(
        F.regexp_extract_all(plain, F.lit(r"[0-9]+"), F.lit(0)),
        lambda d: d.try_cast("int") - 1,
    )
    inside = F.array_distinct(F.filter(named, lambda i: i.isNotNull() & (i >= 0) & (i < n)))
    everyone = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.concat(inside, F.array_except(everyone, inside))
