"""Ingestion queries: discovery, identity, cleaning, chunking, writing, audit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill import jobs
from passagemill.functions import embed, models, paths, text
from passagemill.functions.batches import bounded_batches
from passagemill.operators import audit, chunking, identity
from passagemill.options import IngestOptions
from passagemill.plans import tables as t
from passagemill.plans.registry import query
from passagemill.sources import files as files_src
from passagemill.sources import pages as pages_src
from passagemill.sources import sinks
from passagemill.streaming import ingest as stream_ingest

ROOT = t.ROOT
NAME = "regexp_extract(path, '[^/]*$')"
EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"
KEY = "replace(path, '/', chr(1))"


def garbage_sql(x: str) -> str:
    return (
        f"coalesce(list_sum([length(w) FOR w IN string_split_regex({x}, '\\s+') IF length(w) > 30])::DOUBLE, 0)"
        f" / nullif(length(replace(replace({x}, ' ', ''), chr(10), '')), 0)"
    )


def low_quality_sql(x: str, ext: str) -> str:
    words = f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
    mean = f"list_avg(list_transform({words}, lambda w: length(w)))"
    return (
        f"(length(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')) < CASE WHEN {ext} = '.pdf' THEN 500 ELSE 60 END"
        f" OR {mean} IS NULL OR {mean} < 2.2 OR {mean} > 18 OR coalesce({garbage_sql(x)}, 1) > 0.35)"
    )


def keep_sql(x: str) -> str:
    return (
        f"(length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 60 AND coalesce({garbage_sql(f'trim({x})')}, 1) <= 0.5)"
    )


def clean_sql(x: str) -> str:
    lines = (
        f"list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches(l, '\\.{{6,}}')"
        " AND NOT regexp_matches(l, '(?i)^\\s*\\|?\\s*(?:[ivxlcdm]{1,6}|\\d{1,4})\\s*\\|?\\s*$'))"
    )
    blobs = f"regexp_replace(array_to_string({lines}, chr(10)), '[A-Za-z0-9+/=]{{40,}}', ' ', 'g')"
    return f"regexp_replace(regexp_replace({blobs}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


# -- discovery -----------------------------------------------------------


@query(
    f"WITH {t.FILES} SELECT path, {EXT} AS ext FROM files "
    f"WHERE {EXT} IN ('.pdf', '.txt', '.md', '.docx') AND NOT starts_with({NAME}, '.')"
)
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files_src.discover(t.files(spark, sf_dir).select("path"), ROOT, include_parsed=True)
    return found.select("path", paths.extension(F.col("path")).alias("ext"))


@query(
    f"WITH {t.FILES} SELECT path, {KEY} AS sort_key FROM files "
    f"WHERE {EXT} IN ('.pdf', '.txt', '.md', '.docx') AND NOT starts_with({NAME}, '.') "
    "AND NOT list_has_any(string_split(path, '/'), ['parsed', 'sample_set'])"
)
def discover_skip_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files_src.discover(t.files(spark, sf_dir).select("path"), ROOT)
    return found.select("path", paths.sort_key(F.col("path")).alias("sort_key")).orderBy("sort_key")


TREE_SQL = f"""WITH {t.FILES}, placed AS (
  SELECT CASE doc_id % 5 WHEN 0 THEN '.kept/' WHEN 1 THEN '_drafts/' ELSE '' END || substr(path, {len(ROOT) + 2}) AS path, text FROM files)
SELECT path, strlen(text) AS length, sha256(text) AS doc_sha FROM placed
WHERE {EXT} IN ('.pdf', '.txt', '.md', '.docx') AND NOT starts_with({NAME}, '.')"""


@query(TREE_SQL)
def discover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, some below folders whose names start with a dot or underscore, then listed and read."""
    root = sinks.scratch_dir(spark, "tree").removeprefix("file://").removeprefix("file:")
    doc = F.col("doc_id")
    folder = F.when(doc % 5 == 0, ".kept/").when(doc % 5 == 1, "_drafts/").otherwise("")
    inner = F.substring("path", len(ROOT) + 2, 1 << 30)
    files_src.write_files(t.files(spark, sf_dir).select(F.concat(folder, inner).alias("path"), F.col("text").cast("binary").alias("content")), root)
    found = files_src.scan_tree(spark, root)
    return found.select(F.expr(f"substring(path, {len(root) + 2})").alias("path"), "length", identity.content_sha(F.col("content")).alias("doc_sha"))


@query(
    f"WITH {t.FILES} SELECT path, text || chr(65533) || chr(10) || 'end' || chr(10) AS text FROM files WHERE {EXT} IN ('.md', '.txt')"
)
def read_text_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File bytes with a bad byte and both foreign line ends, read as text."""
    tail = F.lit(bytearray(b"\xff\r\nend\r"))
    raw = t.files(spark, sf_dir).select("path", F.concat(F.col("text").cast("binary"), tail).alias("content"))
    return files_src.read_text(raw).select("path", "text")


@query("SELECT doc_id, sha256(text) AS doc_sha FROM documents")
def doc_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    return docs.select("doc_id", identity.content_sha(F.col("text")).alias("doc_sha"))


def hashed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.files(spark, sf_dir).select("path", identity.content_sha(F.col("text")).alias("doc_sha"))


FIRST = (
    f"WITH {t.FILES}, numbered AS (SELECT path, sha256(text) AS doc_sha, "
    f"row_number() OVER (PARTITION BY sha256(text) ORDER BY {KEY}) AS n FROM files)"
)


@query(FIRST + " SELECT path, doc_sha FROM numbered WHERE n = 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.split_copies(hashed_files(spark, sf_dir))[0]


@query(FIRST + f" SELECT path, {NAME} AS name, 'duplicate content' AS reason FROM numbered WHERE n > 1")
def dedup_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = identity.split_copies(hashed_files(spark, sf_dir))[1]
    return copies.select("path", paths.file_name(F.col("path")).alias("name"), "reason")


@query(f"WITH {t.FILES} SELECT path FROM files ORDER BY {KEY} LIMIT 100")
def limit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_src.first_files(t.files(spark, sf_dir).select("path"), 100)


@query(
    f"WITH {t.FILES}, h AS (SELECT path, lang, sha256(text) AS doc_sha, {KEY} AS k FROM files) "
    "SELECT doc_sha, coalesce(arg_min(path, k) FILTER (lang = 'en'), arg_min(path, k)) AS path FROM h GROUP BY doc_sha"
)
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run takes the English files; a stream then brings everything and adds what is new."""
    target = sinks.scratch_dir(spark, "incremental")

    def shaped(df: DataFrame) -> DataFrame:
        return df.select("path", identity.content_sha(F.col("text")).alias("doc_sha"))

    first = t.files(spark, sf_dir).where(F.col("lang") == "en")
    stream_ingest.append_new(shaped(first), target)
    stream = t.table_stream(spark, sf_dir, "documents")
    stream_ingest.ingest_stream(
        shaped(t.as_files(stream)), target, sinks.scratch_dir(spark, "incremental-progress")
    )
    return stream_ingest.read_committed(spark, target).select("doc_sha", "path")


@query(
    f"WITH {t.FILES}, h AS (SELECT path, lang, sha256(text) AS doc_sha, {KEY} AS k FROM files) "
    "SELECT doc_sha, coalesce(arg_min(path, k) FILTER (lang = 'en'), arg_min(path, k)) AS path, true AS as_in_one_run FROM h GROUP BY doc_sha"
)
def ingest_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a first run and of a stream whose batch then runs again: each content once, cut as in one run.

    The second try of the batch stands for a restart after the chunks were written.
    """
    target, progress = sinks.scratch_dir(spark, "replayed"), sinks.scratch_dir(spark, "replayed-progress")

    def shaped(df: DataFrame) -> DataFrame:
        return jobs.hashed(df.select("path", "text"))

    def build(df: DataFrame) -> DataFrame:
        return jobs.text_chunks(df, ROOT).select("path", "doc_sha", "chunk_index", "text")

    stream_ingest.append_new(shaped(t.files(spark, sf_dir).where(F.col("lang") == "en")), target, build, "first")
    stream = t.table_stream(spark, sf_dir, "documents")
    stream_ingest.ingest_stream(shaped(t.as_files(stream)), target, progress, build)
    stream_ingest.append_new(shaped(t.files(spark, sf_dir)), target, build, stream_ingest.batch_name(progress, 0))

    def marks(chunks: DataFrame) -> DataFrame:
        mark = F.xxhash64("chunk_index", "text").cast("decimal(38,0)")
        return chunks.groupBy("path").agg(F.count("*").alias("n"), F.sum(mark).alias("mark"))

    taken = stream_ingest.ledger_of(target).hashes(spark).select("doc_sha", "path")
    got = marks(stream_ingest.read_committed(spark, target))
    want = marks(build(shaped(t.files(spark, sf_dir).join(taken.select("path"), "path", "left_semi"))))
    both = taken.join(got.select("path", F.struct("n", "mark").alias("got")), "path", "left")
    both = both.join(want.select("path", F.struct("n", "mark").alias("want")), "path", "left")
    return both.select("doc_sha", "path", F.col("got").eqNullSafe(F.col("want")).alias("as_in_one_run"))


@query(
    f"WITH {t.FILES} SELECT {EXT} AS source_ext, 2 * count(*) AS n_rows, count(*) AS n_files FROM files GROUP BY ALL"
)
def write_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace a chunk table, then append the same rows again, and count what is stored."""
    target = sinks.scratch_dir(spark, "chunks")
    rows = t.files(spark, sf_dir).select("path", "text", paths.extension(F.col("path")).alias("source_ext"))
    sinks.write_chunks(rows, target, drop_old=True)
    sinks.write_chunks(rows, target)
    stored = spark.read.parquet(target)
    return stored.groupBy("source_ext").agg(
        F.count("*").alias("n_rows"), F.count_distinct("path").alias("n_files")
    )


@query(
    f"WITH {t.FILES} SELECT path, split_part(path, '/', 3) AS category, 'manual' AS with_override, "
    "split_part(path, '/', -2) AS without_root FROM files"
)
def category_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return t.files(spark, sf_dir).select(
        "path",
        paths.category(path, ROOT).alias("category"),
        paths.category(path, ROOT, "manual").alias("with_override"),
        paths.category(path, None).alias("without_root"),
    )


@query(
    f"""WITH {t.FILES}, rel AS (
      SELECT path, CASE WHEN starts_with(path, '{ROOT}/src1/') THEN substr(path, {len(ROOT) + 7}) ELSE path END AS source_path FROM files)
    SELECT path, {NAME} AS name, {NAME} AS original_filename, source_path,
      regexp_replace(source_path, '/[^/]*$', '') AS source_dir, {EXT} AS source_ext FROM rel"""
)
def path_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path fields below one source's folder; files elsewhere keep their full path."""
    path = F.col("path")
    return t.files(spark, sf_dir).select("path").withColumns(paths.stamp_columns(path, f"{ROOT}/src1"))


@query(
    """WITH lines AS (
      SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
    SELECT source || '/doc_' || doc_id || '.pdf' AS path,
      '# doc_' || doc_id || coalesce(string_agg(chr(10) || chr(10) || '## Page ' || n || chr(10) || chr(10) || trim(line), '' ORDER BY n)
        FILTER (n % 3 <> 0 AND trim(line) <> ''), '') AS text
    FROM lines GROUP BY source, doc_id"""
)
def pages_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_src.pages_to_markdown(t.pages(spark, sf_dir))


@query(
    f"""WITH {t.FILES} SELECT path,
      CASE WHEN {EXT} = '.pdf' THEN CASE WHEN n_chars * 1000 >= 15728640 THEN 'pymupdf-text' ELSE 'pymupdf4llm' END
        WHEN {EXT} IN ('.txt', '.md') THEN 'text' END AS auto_parser,
      CASE WHEN {EXT} = '.pdf' THEN 'pymupdf-text' WHEN {EXT} IN ('.txt', '.md') THEN 'text' END AS text_parser,
      CASE WHEN {EXT} = '.pdf' THEN 'pymupdf4llm' WHEN {EXT} IN ('.txt', '.md') THEN 'text' END AS markdown_parser
    FROM files"""
)
def parser_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes by suffix and size, for files a thousand times as long as the documents."""
    sized = t.files(spark, sf_dir).select("path", (F.col("n_chars") * 1000).alias("length"))
    ext = paths.extension(F.col("path"))
    modes = {
        f"{mode}_parser": paths.parser_route(ext, F.col("length"), IngestOptions(pdf_parser=mode))
        for mode in ("auto", "text", "markdown")
    }
    return sized.select("path", *[c.alias(name) for name, c in modes.items()])


# -- cleaning and quality ------------------------------------------------

NOISE_SQL = (
    "'Contents ........ ' || doc_id || chr(10) || 'Title' || chr(10) || '  | xiv |' || chr(10) || text || chr(10) || chr(10) || chr(10)"
    " || chr(10) || '12' || chr(10) || repeat('QUJD', 13) || ' end' || chr(10) || 'see ......' || chr(10)"
)


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with contents leaders, page numbers, blank lines and a binary run put in."""
    doc = F.col("doc_id").cast("string")
    return t.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.lit("Contents ........ "), doc, F.lit("\nTitle\n  | xiv |\n"), "text", F.lit("\n\n\n\n12\n"),
            F.repeat(F.lit("QUJD"), F.lit(13)), F.lit(" end\nsee ......\n"),
        ).alias("text"),
    )


@query(f"SELECT doc_id, round({garbage_sql('text')}, 6) AS garbage_fraction FROM documents")
def garbage_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(text.garbage_fraction(F.col("text")), 6).alias("garbage_fraction"))


@query(
    f"""SELECT doc_id, array_to_string(list_filter(string_split({NOISE_SQL}, chr(10)),
      lambda l: NOT regexp_matches(l, '\\.{{6,}}')), chr(10)) AS text FROM documents"""
)
def drop_toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy(spark, sf_dir).select("doc_id", text.drop_toc_lines(F.col("text")).alias("text"))


@query(
    f"""SELECT doc_id, array_to_string(list_filter(string_split({NOISE_SQL}, chr(10)), lambda l:
      NOT regexp_matches(l, '(?i)^\\s*\\|?\\s*(?:[ivxlcdm]{{1,6}}|\\d{{1,4}})\\s*\\|?\\s*$')), chr(10)) AS text FROM documents"""
)
def drop_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy(spark, sf_dir).select("doc_id", text.drop_page_number_lines(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9+/=]{40,}', ' ', 'g') AS text FROM documents")
def strip_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", text.strip_base64(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {clean_sql(NOISE_SQL)} AS text FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy(spark, sf_dir).select("doc_id", text.clean_text(F.col("text")).alias("text"))


GATED = f"WITH {t.CORPUS}, gated AS (SELECT path, {low_quality_sql('text', EXT)} AS low_quality FROM corpus)"


@query(GATED + " SELECT path, low_quality FROM gated")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = text.is_low_quality(F.col("text"), paths.extension(F.col("path")))
    return t.corpus(spark, sf_dir).select("path", low.alias("low_quality"))


@query(
    f"WITH {t.CORPUS}, cleaned AS (SELECT path, {clean_sql('text')} AS text FROM corpus) "
    f"SELECT path, {NAME} AS name, '{text.LOW_QUALITY}' AS reason FROM cleaned WHERE {low_quality_sql('text', EXT)}"
)
def skipped_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = chunking.gate(t.corpus(spark, sf_dir), paths.extension(F.col("path")))
    return rejected.select("path", paths.file_name(F.col("path")).alias("name"), "reason")


@query(
    """SELECT doc_id, CASE WHEN length(flat) > 400 THEN left(flat, 400) || '…' ELSE flat END AS snippet
    FROM (SELECT doc_id, regexp_replace(trim(text, ' ' || chr(10)), '\\s+', ' ', 'g') AS flat FROM documents)"""
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


# -- chunking ------------------------------------------------------------


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a header of varying level before every line, and fenced code at the top."""
    doc = F.col("doc_id")

    def with_header(line, i):
        level = (1 + (i * 7 + doc) % 4).cast("int")
        return F.concat(F.repeat(F.lit("#"), level), F.lit(" Part "), i.cast("string"), F.lit("\n"), line)

    lead = F.concat(F.lit("lead "), doc.cast("string"), F.lit("\n```\n# no header\n```\n"))
    return t.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(lead, F.array_join(F.transform(F.split("text", "\n"), with_header), "\n")).alias("text"),
    )


@query(
    """WITH raw AS (
      SELECT doc_id, string_split('lead ' || doc_id || chr(10) || '```' || chr(10) || '# no header' || chr(10) || '```' || chr(10)
        || array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
          repeat('#', (1 + ((i - 1) * 7 + doc_id) % 4)::INT) || ' Part ' || (i - 1) || chr(10) || l), chr(10)), chr(10)) AS ls
      FROM documents),
    lines AS (SELECT doc_id, trim(unnest(ls)) AS line, generate_subscripts(ls, 1) AS pos FROM raw),
    fenced AS (
      SELECT *, sum(CASE WHEN starts_with(line, '```') OR starts_with(line, '~~~') THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) % 2 = 1 AS inside FROM lines),
    leveled AS (
      SELECT *, CASE WHEN NOT inside AND regexp_matches(line, '^#{1,4}( |$)')
        THEN length(regexp_extract(line, '^#+')) END AS lv, trim(regexp_replace(line, '^#+', '')) AS title FROM fenced),
    placed AS (
      SELECT doc_id, pos, line, count(lv) OVER w AS section,
        max(CASE WHEN lv = 1 THEN {'p': pos, 't': title} END) OVER w AS h1,
        max(CASE WHEN lv = 2 THEN {'p': pos, 't': title} END) OVER w AS h2,
        max(CASE WHEN lv = 3 THEN {'p': pos, 't': title} END) OVER w AS h3,
        max(CASE WHEN lv = 4 THEN {'p': pos, 't': title} END) OVER w AS h4,
        coalesce(max(CASE WHEN lv < 2 THEN pos END) OVER w, 0) AS b2,
        coalesce(max(CASE WHEN lv < 3 THEN pos END) OVER w, 0) AS b3,
        coalesce(max(CASE WHEN lv < 4 THEN pos END) OVER w, 0) AS b4
      FROM leveled WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, section::INT AS section_index,
      coalesce(any_value(h1.t), '') || ' > ' || coalesce(any_value(CASE WHEN h2.p > b2 THEN h2.t END), '') || ' > '
        || coalesce(any_value(CASE WHEN h3.p > b3 THEN h3.t END), '') || ' > '
        || coalesce(any_value(CASE WHEN h4.p > b4 THEN h4.t END), '') AS header_path,
      regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS text
    FROM placed GROUP BY doc_id, section"""
)
def header_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = headed(spark, sf_dir).select(
        "doc_id", F.posexplode(chunking.header_sections(F.col("text"))).alias("section_index", "s")
    )
    path = F.array_join(F.transform("s.headers", lambda h: F.coalesce(h, F.lit(""))), " > ")
    return sections.select("doc_id", "section_index", path.alias("header_path"), "s.text")


def places(size: int, overlap: int):
    """Holds the parts against the text at the places that the splitter names: characters other than blanks and
    line breaks that parts cover, and whether no two neighbours share more than ``overlap``.

    A part is not searched for, as a text that repeats itself holds it at several places.  Both only count if
    every part stands at its place, each after the one before; else nothing is covered and neither holds.
    """

    @F.arrow_udf("struct<solid: long, bounded: boolean>")
    def run(texts: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for text_, found in zip(texts, parts):
            text_, found = text_.as_py(), found.as_py()
            spans = list(chunking.split_spans(text_, size, overlap))
            placed = [text_[a:b] for a, b in spans] == found and all(a[0] < b[0] for a, b in zip(spans, spans[1:]))
            end, solid, bounded = 0, 0, placed
            for start, stop in spans if placed else []:
                bounded = bounded and end - start <= overlap
                fresh = text_[max(start, end) : stop]
                solid += len(fresh) - fresh.count(" ") - fresh.count("\n")
                end = max(end, stop)
            out.append({"solid": solid, "bounded": bounded})
        return pa.array(out, pa.struct([("solid", pa.int64()), ("bounded", pa.bool_())]))

    return run


@query(
    """SELECT doc_id, true AS all_within_size, true AS none_blank, true AS all_from_text, true AS starts_alike, true AS ends_alike,
      length(regexp_replace(text, '[ \\n]', '', 'g')) AS solid_covered, true AS overlaps_bounded
    FROM documents WHERE trim(text, ' ' || chr(10)) <> ''"""
)
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size-bounded parts of every document, told by what must hold for all of them."""
    options = IngestOptions()
    cut = chunking.size_splitter(options.chunk_size, options.overlap)
    bounded_batches(spark)
    docs = t.table(spark, sf_dir, "documents").select("doc_id", text.strip(F.col("text")).alias("text"))
    parts = docs.where(F.col("text") != "").select("doc_id", "text", F.get(cut(F.array("text")), F.lit(0)).alias("parts"))
    last = F.get("parts", F.size("parts") - 1)
    placed = places(options.chunk_size, options.overlap)("text", "parts")
    return parts.select(
        "doc_id",
        F.forall("parts", lambda p: F.length(p) <= options.chunk_size).alias("all_within_size"),
        F.forall("parts", lambda p: text.strip(p) != "").alias("none_blank"),
        F.forall("parts", lambda p: F.contains(F.col("text"), p)).alias("all_from_text"),
        F.startswith("text", F.get("parts", F.lit(0))).alias("starts_alike"),
        F.endswith(F.col("text"), last).alias("ends_alike"),
        placed["solid"].alias("solid_covered"),
        placed["bounded"].alias("overlaps_bounded"),
    )


LINES = """lines AS (
  SELECT doc_id, source, text AS doc, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""


@query(f"WITH {LINES} SELECT doc_id, line_no::INT AS line_no, {keep_sql('line')} AS keep FROM lines")
def chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk filter on every line of every document."""
    rows = t.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", text.keep_chunk(F.col("line")).alias("keep"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept lines as chunks, numbered inside their document's own row."""
    kept = t.corpus(spark, sf_dir).select(
        "path",
        "doc_id",
        identity.content_sha(F.col("text")).alias("doc_sha"),
        F.filter(F.split("text", "\n"), text.keep_chunk).alias("kept"),
    )
    return chunking.explode_once(kept, "kept", "chunk_index", "text", count="n_chunks")


KEPT_LINES = f"""{LINES}, kept AS (
  SELECT *, '{ROOT}/' || source || '/doc_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.pdf' END AS path,
    sha256(doc) AS doc_sha,
    (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS chunk_index,
    (count(*) OVER (PARTITION BY doc_id))::INT AS n_chunks
  FROM lines WHERE {keep_sql('line')})"""


@query(
    f"""WITH {KEPT_LINES} SELECT sha256(doc_sha || '|' || chunk_index) AS chunk_id, line AS text, {NAME} AS name,
      {NAME} AS original_filename, substr(path, {len(ROOT) + 2}) AS source_path, source AS source_dir, {EXT} AS source_ext,
      'text' AS parser, source AS category, chunk_index, n_chunks, doc_sha FROM kept"""
)
def chunk_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = chunking.stamp_chunks(line_chunks(spark, sf_dir), ROOT)
    return stamped.select(
        "chunk_id", "text", "name", "original_filename", "source_path", "source_dir", "source_ext",
        "parser", "category", "chunk_index", "n_chunks", "doc_sha",
    )


@query()
def ingest_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedup, clean, gate, sections, size split, filter, stamps: one plan, one join."""
    chunks = jobs.text_chunks(jobs.hashed(t.corpus(spark, sf_dir).select("path", "text")), ROOT)
    return chunks.select(
        "chunk_id", "path", "chunk_index", "n_chunks", "source_ext", "category", "parser", "doc_sha", "text",
        F.array_join("headers", " > ").alias("header_path"),
    )


# -- embedding and collection --------------------------------------------

CALLED = 100  # texts a call


def length_encoder():
    """A stand-in for an embedding model: a text's length, its first letter, and how many texts the call had."""
    return lambda texts: [[float(len(x)), float(ord(x[0]) if x else 0), float(len(texts))] for x in texts]


@query(
    "SELECT count(*) AS n_texts, count(*) AS own_vectors, true AS full_calls, "
    "count(*) FILTER (length(text) > 300) AS long_texts FROM documents"
)
def encode_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text gets its own vector; but for the last ones of each task, calls have all the texts they may."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "text")
    v = F.col("embedding")
    made = models.encoded(docs, length_encoder, batch=CALLED).withColumn("task", F.spark_partition_id())
    first = F.coalesce(F.ascii(F.substring("text", 1, 1)), F.lit(0))
    own = (F.get(v, F.lit(0)) == F.length("text")) & (F.get(v, F.lit(1)) == first)
    per_task = made.groupBy("task").agg(
        F.count("*").alias("n"),
        F.count_if(own).alias("own"),
        F.count_if(F.get(v, F.lit(2)) == CALLED).alias("full"),
        F.count_if(F.get(v, F.lit(0)) > 300).alias("long"),
    )
    return per_task.agg(
        F.sum("n").alias("n_texts"),
        F.sum("own").alias("own_vectors"),
        F.every(F.col("full") == F.col("n") - F.col("n") % CALLED).alias("full_calls"),
        F.sum("long").alias("long_texts"),
    )



@query(
    f"WITH {t.word_counts_sql('dv', 'documents', 'doc_id', 'text')} "
    "SELECT id AS doc_id, array_to_string(list_transform(v, lambda x: x::INT), ',') AS counts, "
    "round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, "
    "round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first_unit FROM dv"
)
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = embed.embed_hashed(t.table(spark, sf_dir, "documents").select("doc_id", "text"))
    v = F.col("embedding")
    return docs.select(
        "doc_id",
        F.array_join(v.cast("array<int>"), ",").alias("counts"),
        F.round(embed.norm(v), 6).alias("norm"),
        F.round(F.get(embed.unit(v), F.lit(0)), 6).alias("first_unit"),
    )


@query(
    f"WITH {t.FILES} SELECT path, {EXT} AS source_ext FROM files "
    f"WHERE NOT (starts_with(path, '{ROOT}/src1/') AND {EXT} = '.pdf')"
)
def delete_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop one source's PDFs from a written table and read what is left."""
    source, target = sinks.scratch_dir(spark, "before-delete"), sinks.scratch_dir(spark, "after-delete")
    rows = t.files(spark, sf_dir).select("path", "text", paths.extension(F.col("path")).alias("source_ext"))
    sinks.write_chunks(rows, source, drop_old=True)
    gone = F.col("path").startswith(f"{ROOT}/src1/") & (F.col("source_ext") == ".pdf")
    sinks.rewrite_without(spark, source, target, gone)
    return spark.read.parquet(target).select("path", "source_ext")


@query(
    f"WITH {t.FILES} SELECT {EXT} AS source_ext, count(*) AS n_rows FROM files "
    f"WHERE NOT ({EXT} = '.pdf' AND starts_with(path, '{ROOT}/src1/')) GROUP BY ALL"
)
def delete_partitionwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop one source's PDFs in place: only the PDF partition is written again."""
    target = sinks.scratch_dir(spark, "deleted-in-place")
    rows = t.files(spark, sf_dir).select("path", "text", paths.extension(F.col("path")).alias("source_ext"))
    sinks.write_chunks(rows, target, drop_old=True)
    gone = F.col("path").startswith(f"{ROOT}/src1/") & (F.col("source_ext") == ".pdf")
    sinks.delete_in_place(spark, target, gone)
    return spark.read.parquet(target).groupBy("source_ext").agg(F.count("*").alias("n_rows"))


# -- audit ---------------------------------------------------------------


@query(
    f"""SELECT count(*) AS chunks, min(length(text)) AS chunk_chars_min, sum(length(text))::BIGINT // count(*) AS chunk_chars_avg,
      max(length(text)) AS chunk_chars_max, round(avg({garbage_sql('text')}), 6) AS avg_garbage_fraction FROM documents"""
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = audit.corpus_stats(t.table(spark, sf_dir, "documents"))
    return stats.withColumn("avg_garbage_fraction", F.round("avg_garbage_fraction", 6))


@query(
    f"""WITH {KEPT_LINES}, {t.CORPUS},
    numbered AS (SELECT path, text, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY {KEY}) AS n FROM corpus),
    cleaned AS (SELECT path, sha, n, {clean_sql('text')} AS text FROM numbered),
    judged AS (SELECT path, sha, CASE WHEN n > 1 THEN 'duplicate content'
      WHEN {low_quality_sql('text', EXT)} THEN '{text.LOW_QUALITY}' END AS reason FROM cleaned),
    counted AS (SELECT path, count(*) AS chunks FROM kept GROUP BY path)
    SELECT substr(path, {len(ROOT) + 2}) AS path, {NAME} AS name, CASE WHEN reason IS NULL THEN split_part(path, '/', 3) END AS category,
      CASE WHEN reason IS NULL THEN sha END AS sha256, CASE WHEN reason IS NULL THEN coalesce(chunks, 0) END AS chunks, reason
    FROM judged LEFT JOIN counted USING (path)"""
)
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all files, counting kept lines as chunks."""
    files = jobs.hashed(t.corpus(spark, sf_dir).select("path", "text"))
    return audit.file_summary(jobs.text_outcomes(files, ROOT), line_chunks(spark, sf_dir), ROOT)


@query(
    f"""WITH {t.CORPUS},
    numbered AS (SELECT path, text, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY {KEY}) AS n FROM corpus),
    cleaned AS (SELECT path, sha, n, {clean_sql('text')} AS text FROM numbered),
    judged AS (SELECT path, sha, CASE WHEN n > 1 THEN 'duplicate content'
      WHEN {low_quality_sql('text', EXT)} THEN '{text.LOW_QUALITY}' END AS reason FROM cleaned)
    SELECT CASE WHEN reason IS NULL THEN 'file' ELSE 'skipped' END AS kind, substr(path, {len(ROOT) + 2}) AS path,
      CASE WHEN reason IS NULL THEN sha END AS sha256, reason FROM judged"""
)
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file records of a whole run, read back from its manifest."""
    files = t.corpus(spark, sf_dir).select("path", "text")
    records = jobs.ingest(files, sinks.scratch_dir(spark, "run"), ROOT, IngestOptions(dry_run=True)).records
    field = lambda name: F.get_json_object("record", f"$.{name}").alias(name)
    return records.where("kind <> 'run'").select("kind", "path", field("sha256"), field("reason"))


@query(
    f"""WITH {t.CORPUS},
    numbered AS (SELECT path, text, row_number() OVER (PARTITION BY sha256(text) ORDER BY {KEY}) AS n FROM corpus),
    cleaned AS (SELECT path, n, {clean_sql('text')} AS text FROM numbered),
    judged AS (SELECT n > 1 OR {low_quality_sql('text', EXT)} AS skipped FROM cleaned)
    SELECT count(*) AS files_discovered, count(*) FILTER (NOT skipped) AS files_ingested, count(*) FILTER (skipped) AS files_skipped,
      1800::BIGINT AS chunk_size, 250::BIGINT AS overlap, 256::BIGINT AS embed_batch, true AS chunks_add_up, true AS all_written FROM judged"""
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run row of a whole run: what it counted, and whether that agrees with its file records and its chunk table."""
    target = sinks.scratch_dir(spark, "run")
    records = jobs.ingest(t.corpus(spark, sf_dir).select("path", "text"), target, ROOT).records
    number = lambda field: F.get_json_object("record", f"$.{field}").cast("long")
    of_files = records.where("kind = 'file'").agg(F.sum(number("chunks")).alias("told"))
    stored = spark.read.parquet(target).agg(F.count("*").alias("stored"))
    fields = ["totals.files_discovered", "totals.files_ingested", "totals.files_skipped", "chunking.chunk_size", "chunking.overlap", "target.embed_batch"]
    head = records.where("kind = 'run'").select(
        *[number(f).alias(f.rsplit(".", 1)[1]) for f in fields], number("totals.chunks").alias("chunks"), number("totals.chunks_written").alias("written")
    )
    one = F.lit(1).alias("one")
    whole = head.select("*", one).join(of_files.select("told", one), "one").join(stored.select("stored", one), "one")
    agree = [(F.col("chunks") == F.col("told")).alias("chunks_add_up"), ((F.col("written") == F.col("stored")) & (F.col("chunks") == F.col("stored"))).alias("all_written")]
    return whole.select(*[f.rsplit(".", 1)[1] for f in fields], *agree)


@query(
    f"""WITH {KEPT_LINES}, ordered AS (
      SELECT path, chunk_index, line AS text, row_number() OVER (ORDER BY {KEY}, chunk_index) - 1 AS place,
        count(*) OVER () AS total FROM kept)
    SELECT path, chunk_index, text, place::BIGINT AS place FROM ordered
    WHERE place % greatest(1, total // 3) = 0 AND place < 3 * greatest(1, total // 3)"""
)
def sample_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample is taken of a written chunk table: it is read by key several times."""
    staged = sinks.scratch_dir(spark, "sampled-chunks")
    line_chunks(spark, sf_dir).select("path", "chunk_index", "text").write.parquet(staged)
    return audit.sample_chunks(spark.read.parquet(staged), 3)


@query()
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run with its embedded chunk table, told as audit records."""
    files = t.corpus(spark, sf_dir).select("path", "text")
    return jobs.ingest(files, sinks.scratch_dir(spark, "run"), ROOT).records
