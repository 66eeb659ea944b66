"""Structure-aware chunking of transcript compilations.

Input is a paragraph table ``(path, para_index, level, text)``: level 0 is body
text, 1 opens a video block, 2 and 3 open its sections.  Order is ``para_index``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import paths
from passagemill.functions.text import SPACE, alnum_count, rstrip, strip
from passagemill.operators.carry import carry_forward, span_if_long
from passagemill.operators.packing import pack, split_pieces
from passagemill.options import TranscriptOptions

# Template words, section labels and their order.
SOURCE_H2 = "视频来源"
OUTLINE_H2 = "大纲"
SUMMARY_H2 = "总结"
SPEAKER = "说话人"
SECTION_WORDS = [
    ("one_sentence", ("one-sentence", "one sentence")),
    ("takeaways", ("takeaway",)),
    ("qa", ("q&a", "q & a", "in-depth")),
    ("keywords", ("key word", "keyword", "tag")),
    ("audience", ("audience",)),
    ("terminology", ("terminolog",)),
]
SUMMARY_ORDER = ("one_sentence", "takeaways", "outline", "keywords", "audience")
SECTION_LABELS = {
    "summary": "Summary",
    "qa": "Q&A",
    "terminology": "Terminology",
    "body": "Body",
    "transcript": "Transcript",
}
LABEL_CHARS = 120
UNTITLED = "untitled"
NO_BLOCK = -1
# Room for paragraph positions below a summary section's rank.
RANK_STEP = 1 << 40


def speaker_pattern(colons: str = ":") -> str:
    time = r"\p{Nd}[\p{Nd}:]{3,7}"
    gap = f"{SPACE}*"
    return rf"^{SPEAKER}{gap}(\p{{Nd}}+){gap}[{colons}]{gap}{time}{gap}-{gap}{time}{gap}$"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def classify_section(heading: Column) -> Column:
    """Bucket of a level-3 heading; the first matching word list wins."""
    low = F.lower(heading)
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for bucket, words in SECTION_WORDS:
        found = found.when(any_of(low, words), bucket)
    return found.otherwise("body")


def detect_template(paragraphs: DataFrame) -> DataFrame:
    """``(path, is_compilation)``; combined before the shuffle."""
    hit = (F.col("level") == 2) & any_of(F.col("text"), (SOURCE_H2, OUTLINE_H2, SUMMARY_H2))
    return paragraphs.groupBy("path").agg(F.bool_or(hit).alias("is_compilation"))


def volume_name(stem: Column) -> Column:
    cut = F.regexp_replace(stem, r"(?i)_for AI inputs[^\n]*\z", "")
    return F.regexp_replace(F.regexp_replace(cut, f"{SPACE}+", " "), r"^[ _\-–]+|[ _\-–]+\z", "")


def annotate(paragraphs: DataFrame, options: TranscriptOptions = TranscriptOptions()) -> DataFrame:
    """Add every paragraph's running state.

    ``block_start, title``: the video block; ``bucket``: its section, ``drop`` where
    text is discarded; ``utterance_start, speaker``: the utterance it belongs to,
    null outside a transcript; ``is_marker``: a speaker marker.
    """
    span = span_if_long(paragraphs, "para_index", options.span)
    level, text = F.col("level"), F.col("text")
    number = F.regexp_extract(text, speaker_pattern(options.speaker_colons), 1)
    marker = (level != 1) & (number != "")
    opens_block = level == 1
    heading2 = (
        F.when(text.contains(SOURCE_H2), "drop").when(text.contains(OUTLINE_H2), "outline").otherwise("body")
    )
    nowhere = F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("string").alias("speaker"))
    marks = {
        "_block": F.when(opens_block, F.struct(F.col("para_index").alias("start"), text.alias("title"))),
        "_bucket": F.when(opens_block, "body")
        .when(marker, F.lit(None))
        .when(level == 2, heading2)
        .when(level == 3, classify_section(text)),
        "_talk": F.when(marker, F.struct(F.col("para_index").alias("start"), number.alias("speaker"))).when(
            level.isin(1, 2, 3), nowhere
        ),
    }
    state = carry_forward(
        paragraphs.select("path", F.col("para_index").cast("long").alias("para_index"), "level", "text"),
        ["path"],
        "para_index",
        marks,
        span,
    )
    return state.select(
        "path",
        "para_index",
        "level",
        "text",
        F.coalesce("_block.start", F.lit(NO_BLOCK)).alias("block_start"),
        F.coalesce("_block.title", F.lit("")).alias("title"),
        F.coalesce("_bucket", F.lit("body")).alias("bucket"),
        F.when((level == 0) & ~marker, F.col("_talk.start")).alias("utterance_start"),
        F.when((level == 0) & ~marker, F.col("_talk.speaker")).alias("speaker"),
        marker.alias("is_marker"),
    )


def split_blocks(annotated: DataFrame) -> DataFrame:
    """One row per video block that holds any paragraph; a lone title gives none."""
    return (
        annotated.where(F.col("level") != 1)
        .groupBy("path", "block_start")
        .agg(
            F.max("title").alias("title"),
            F.count("*").alias("n_paragraphs"),
            F.sum(F.length("text")).alias("n_chars"),
        )
    )


def section_rows(annotated: DataFrame) -> DataFrame:
    """Paragraphs that reach a section bucket: not headings, markers, speech or dropped text."""
    level = F.col("level")
    return annotated.where(
        ~F.col("is_marker")
        & ~level.isin(1, 2, 3)
        & F.col("utterance_start").isNull()
        & (F.col("bucket") != "drop")
    ).select("path", "block_start", "title", "para_index", "bucket", "text")


def _ordered_join(order: str, text: str, joiner: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), joiner)


def utterances(annotated: DataFrame) -> DataFrame:
    """One text per speaker turn, timestamps gone; turns without lines do not appear."""
    return (
        annotated.where(F.col("utterance_start").isNotNull())
        .groupBy("path", "block_start", "utterance_start", "speaker")
        .agg(_ordered_join("para_index", "text", " ").alias("said"))
        .select(
            "path",
            "block_start",
            "utterance_start",
            "speaker",
            F.concat(F.lit(SPEAKER), F.col("speaker"), F.lit(": "), F.col("said")).alias("text"),
        )
    )


def qa_pairs(sections: DataFrame, options: TranscriptOptions = TranscriptOptions()) -> DataFrame:
    """Question-with-answer texts: a paragraph ending in a question mark opens a pair."""
    span = span_if_long(sections, "para_index", options.span)
    placed = with_pairs(sections.where(F.col("bucket") == "qa"), F.lit(True), span)
    return placed.groupBy("path", "block_start", "pair_start").agg(_ordered_join("para_index", "text", "\n").alias("text"))


def with_pairs(rows: DataFrame, is_qa: Column, span: int | None) -> DataFrame:
    """Add ``pair_start``: the last question at or before a row, -1 ahead of the first one."""
    asks = is_qa & rstrip(F.col("text")).rlike(r"[?？]\z")
    placed = carry_forward(
        rows, ["path", "block_start"], "para_index", {"pair_start": F.when(asks, F.col("para_index"))}, span
    )
    return placed.withColumn("pair_start", F.coalesce("pair_start", F.lit(NO_BLOCK)))


def summary_rank(bucket: Column) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("long"))
    for rank, name in enumerate(SUMMARY_ORDER):
        found = found.when(bucket == name, F.lit(rank).cast("long"))
    return found


def summary_pieces(sections: DataFrame) -> DataFrame:
    """Summary paragraphs with ``pos`` in bucket order, then text order."""
    rank = summary_rank(F.col("bucket"))
    return sections.where(rank.isNotNull()).select(
        "path", "block_start", (rank * RANK_STEP + F.col("para_index")).alias("pos"), F.col("text").alias("piece")
    )


def video_labels(annotated: DataFrame) -> DataFrame:
    """``(path, block_start, title, video)``: the one-sentence summary's start, else the title."""
    one = section_rows(annotated).where(F.col("bucket") == "one_sentence")
    joined = one.groupBy("path", "block_start").agg(_ordered_join("para_index", "text", " ").alias("_one"))
    short = rstrip(F.substring(strip(F.col("_one")), 1, LABEL_CHARS))
    return (
        split_blocks(annotated)
        .join(joined, ["path", "block_start"], "left")
        .select(
            "path",
            "block_start",
            "title",
            F.coalesce(F.nullif(short, F.lit("")), F.nullif("title", F.lit("")), F.lit(UNTITLED)).alias("video"),
        )
    )


def section_pieces(annotated: DataFrame, span: int | None) -> DataFrame:
    """``(path, block_start, section_type, pos, piece)`` for all five section types.

    One pass: every row is told its section type and the position of its piece,
    then each piece's rows are joined.  Summary and plain rows are pieces of their
    own, Q&A rows join their question, speech joins its marker.
    """
    bucket, here = F.col("bucket"), F.col("para_index")
    spoken = F.col("utterance_start").isNotNull()
    rank = summary_rank(bucket)
    paired = with_pairs(
        annotated.where(spoken | (~F.col("is_marker") & ~F.col("level").isin(1, 2, 3) & (bucket != "drop"))),
        ~spoken & (bucket == "qa"),
        span,
    )
    kind = (
        F.when(spoken, "transcript").when(rank.isNotNull(), "summary").otherwise(bucket).alias("section_type")
    )
    pos = (
        F.when(spoken, F.col("utterance_start"))
        .when(rank.isNotNull(), rank * RANK_STEP + here)
        .when(bucket == "qa", F.greatest("pair_start", F.lit(0)))
        .otherwise(here)
    )
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct("para_index", "text"))), lambda r: r["text"]
    )
    said = F.concat(F.lit(SPEAKER), F.col("speaker"), F.lit(": "), F.array_join("rows", " "))
    return (
        paired.select("path", "block_start", kind, pos.alias("pos"), "speaker", "para_index", "text")
        .groupBy("path", "block_start", "section_type", "pos", "speaker")
        .agg(rows.alias("rows"))
        .select(
            "path",
            "block_start",
            "section_type",
            "pos",
            F.when(F.col("speaker").isNotNull(), said).otherwise(F.array_join("rows", "\n")).alias("piece"),
        )
    )


def packed_sections(annotated: DataFrame, options: TranscriptOptions = TranscriptOptions()) -> DataFrame:
    """``(path, block_start, section_type, chunk_start, text)`` packed to each type's target."""
    span = span_if_long(annotated, "para_index", options.span)
    parts = split_pieces(section_pieces(annotated, span), options.rules)
    return pack(parts, ["path", "block_start", "section_type"], span)


def typed_chunks(paragraphs: DataFrame, options: TranscriptOptions = TranscriptOptions()) -> DataFrame:
    """Chunks with a context line ``volume › video › section``.

    Ordered by ``(block_start, section_rank, chunk_start)`` within a path.
    """
    annotated = annotate(paragraphs, options)
    names = video_labels(annotated).withColumn("volume", volume_name(paths.stem(F.col("path"))))
    kinds = list(SECTION_LABELS)
    label = F.lit(None).cast("string")
    rank = F.lit(None).cast("int")
    for i, kind in enumerate(kinds):
        label = F.when(F.col("section_type") == kind, SECTION_LABELS[kind]).otherwise(label)
        rank = F.when(F.col("section_type") == kind, i).otherwise(rank)
    chunks = packed_sections(annotated, options).where(alnum_count(F.col("text")) >= options.min_alnum)
    return (
        chunks.join(names, ["path", "block_start"])
        .withColumn("label", label)
        .select(
            "path",
            "block_start",
            rank.alias("section_rank"),
            "chunk_start",
            "section_type",
            F.col("title").alias("video_title"),
            F.array("volume", "video", "label", F.lit(None).cast("string")).alias("headers"),
            F.concat(F.concat_ws(" › ", "volume", "video", "label"), F.lit("\n\n"), F.col("text")).alias("text"),
        )
    )
