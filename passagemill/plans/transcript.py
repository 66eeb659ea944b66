"""Transcript-compilation queries on conversations shaped as paragraph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill import jobs
from passagemill.functions.text import LOW_QUALITY, strip
from passagemill.operators import packing
from passagemill.operators import transcript as tr
from passagemill.plans import tables as t
from passagemill.plans.ingest import clean_sql, low_quality_sql
from passagemill.plans.registry import query
from passagemill.sources import pages as pages_src


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.annotate(t.paragraphs(spark, sf_dir))


@query(
    f"""WITH {t.PARAGRAPHS} SELECT path, bool_or(level = 2 AND (contains(text, '视频来源') OR contains(text, '大纲')
      OR contains(text, '总结'))) AS is_compilation FROM paragraphs GROUP BY path"""
)
def detect_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.detect_template(t.paragraphs(spark, sf_dir))


@query(
    f"""WITH {t.ANNOTATED} SELECT path, block_start, max(title) AS title, count(*) AS n_paragraphs,
      sum(length(text))::BIGINT AS n_chars FROM annotated WHERE level <> 1 GROUP BY path, block_start"""
)
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.split_blocks(annotated(spark, sf_dir))


@query(f"WITH {t.ANNOTATED} SELECT path, para_index, h3 AS bucket FROM flagged WHERE level = 3")
def classify_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = t.paragraphs(spark, sf_dir).where(F.col("level") == 3)
    return headings.select("path", "para_index", tr.classify_section(F.col("text")).alias("bucket"))


@query(f"WITH {t.ANNOTATED} SELECT * FROM sections")
def section_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.section_rows(annotated(spark, sf_dir))


@query(f"WITH {t.ANNOTATED} SELECT * FROM utterances")
def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.utterances(annotated(spark, sf_dir))


@query(f"WITH {t.ANNOTATED} SELECT * FROM qa_pairs")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.qa_pairs(tr.section_rows(annotated(spark, sf_dir)))


@query(t.PACKED.replace("para_rows AS", "RECURSIVE para_rows AS", 1).join(["WITH ", " SELECT * FROM packed"]))
def pack_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.packed_sections(annotated(spark, sf_dir))


HARD_CAP = 400


@query(
    f"""WITH RECURSIVE cut(doc_id, part, done, rest) AS (
      SELECT doc_id, -1, '', trim(text, ' ' || chr(10)) FROM documents
      UNION ALL
      SELECT doc_id, part + 1, rtrim(left(rest, c), ' ' || chr(10)), ltrim(substr(rest, c + 1), ' ' || chr(10)) FROM (
        SELECT *, CASE WHEN length(rest) <= {HARD_CAP} THEN length(rest)
          WHEN contains(substr(rest, {HARD_CAP * 6 // 10 + 1}, {HARD_CAP - HARD_CAP * 6 // 10}), ' ')
            THEN {HARD_CAP} - strpos(reverse(substr(rest, {HARD_CAP * 6 // 10 + 1}, {HARD_CAP - HARD_CAP * 6 // 10})), ' ')
          ELSE {HARD_CAP} END AS c
        FROM cut WHERE rest <> ''))
    SELECT doc_id, part::INT AS part, done AS text FROM cut WHERE part >= 0"""
)
def hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into parts of at most 400 characters."""
    docs = t.table(spark, sf_dir, "documents")
    parts = packing.hard_split(strip(F.col("text")), HARD_CAP)
    return docs.select("doc_id", F.posexplode(parts).alias("part", "text"))


@query(f"WITH {t.ANNOTATED} SELECT path, block_start, pos, piece FROM summary_pieces")
def summary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.summary_pieces(tr.section_rows(annotated(spark, sf_dir)))


@query(f"WITH {t.ANNOTATED} SELECT path, block_start, title, video FROM video_labels")
def video_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.video_labels(annotated(spark, sf_dir))


@query(
    """SELECT conv_id, turn, trim(regexp_replace(regexp_replace(' _ Volume  ' || conv_id || ' –  ' || left(text, 40) || '_for ai inputS_x',
      '_for AI inputs[^\\n]*$', '', 'i'), '\\s+', ' ', 'g'), ' _-–') AS volume FROM conversations"""
)
def volume_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "conversations")
    name = F.concat(
        F.lit(" _ Volume  "), F.col("conv_id").cast("string"), F.lit(" –  "), F.substring("text", 1, 40), F.lit("_for ai inputS_x")
    )
    return rows.select("conv_id", "turn", tr.volume_name(name).alias("volume"))


@query(
    t.PACKED.replace("para_rows AS", "RECURSIVE para_rows AS", 1).join(
        [
            "WITH ",
            """ SELECT k.path, k.block_start, r.rank::INT AS section_rank, chunk_start, section_type, title AS video_title,
              regexp_extract(k.path, '^(.*)_for AI', 1) || ' › ' || video || ' › ' || label || chr(10) || chr(10) || text AS text,
              regexp_extract(k.path, '^(.*)_for AI', 1) || ' | ' || video || ' | ' || label AS header_path
            FROM packed k JOIN rules r USING (section_type) JOIN video_labels v ON v.path = k.path AND v.block_start = k.block_start
            WHERE length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= 60""",
        ]
    )
)
def typed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = tr.typed_chunks(t.paragraphs(spark, sf_dir))
    return chunks.withColumn("header_path", F.array_join("headers", " | ")).drop("headers")


@query(
    f"""WITH {t.PARAGRAPHS} SELECT path, string_agg(CASE WHEN level > 0 THEN repeat('#', level) || ' ' || text ELSE text END,
      chr(10) || chr(10) ORDER BY para_index) AS text FROM paragraphs GROUP BY path"""
)
def paragraphs_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_src.paragraphs_to_markdown(t.paragraphs(spark, sf_dir))


STYLES = ["Heading 1", "heading2", "HEADING  3", "Heading 10", "Normal", "Heading 9"]


@query(
    f"""WITH styled AS (
      SELECT conv_id::VARCHAR AS path, turn AS para_index, {STYLES}[((conv_id + turn) % 6 + 1)::INT] AS style,
        CASE WHEN turn % 5 = 4 THEN ' ' || chr(10) ELSE '  ' || text || chr(10) END AS text FROM conversations)
    SELECT path, para_index,
      CASE WHEN regexp_matches(lower(replace(style, ' ', '')), '^heading[1-9]$') THEN right(style, 1)::INT ELSE 0 END AS level,
      trim(text, ' ' || chr(10)) AS text
    FROM styled WHERE trim(text, ' ' || chr(10)) <> ''"""
)
def paragraph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw styled paragraphs, some of them blank, normalised to levels."""
    styled = t.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("path"),
        F.col("turn").alias("para_index"),
        F.get(F.array(*map(F.lit, STYLES)), ((F.col("conv_id") + F.col("turn")) % 6).cast("int")).alias("style"),
        F.when(F.col("turn") % 5 == 4, F.lit(" \n")).otherwise(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("text"),
    )
    return pages_src.paragraph_levels(styled)


@query()
def ingest_compilations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph tables as stamped chunks: typed where the template fits, else by markdown."""
    rows = t.paragraphs(spark, sf_dir)
    shas = rows.select("path").distinct().withColumn("doc_sha", F.sha2(F.col("path").cast("binary"), 256))
    chunks = jobs.compilation_chunks(rows, shas, None)
    return chunks.select(
        "chunk_id", "path", "parser", "section_type", "video_title", "chunk_index", "n_chunks", "text",
        F.array_join("headers", " > ").alias("header_path"),
    )


@query(
    t.PACKED.replace("para_rows AS", "RECURSIVE para_rows AS", 1).join(
        [
            "WITH ",
            f""", made AS (SELECT DISTINCT path FROM packed WHERE length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 60),
            kinds AS (SELECT path, bool_or(level = 2 AND (contains(text, '视频来源') OR contains(text, '大纲') OR contains(text, '总结'))) AS fits,
              string_agg(CASE WHEN level > 0 THEN repeat('#', level) || ' ' || text ELSE text END, chr(10) || chr(10) ORDER BY para_index) AS md
              FROM paragraphs GROUP BY path),
            cleaned AS (SELECT path, fits, {clean_sql('md')} AS md FROM kinds)
            SELECT path, CASE WHEN fits AND path NOT IN (SELECT path FROM made) THEN '{jobs.NO_USABLE_CHUNKS}'
              WHEN NOT fits AND {low_quality_sql('md', "'.docx'")} THEN '{LOW_QUALITY}' END AS reason FROM cleaned""",
        ]
    )
)
def compilation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a paragraph table's file is not in the corpus, null where it is."""
    rows = t.paragraphs(spark, sf_dir)
    return jobs.compilation_outcomes(rows, tr.typed_chunks(rows))
