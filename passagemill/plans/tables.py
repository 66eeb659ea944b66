"""Bindings: the given tables shaped as files, pages, paragraphs, turns and events.

Each binding has a Spark side and a SQL side that say the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.embed import embed_hashed
from passagemill.operators.conversations import ANSWER, CALL, REASONING, RETRIEVE

ROOT = "/corpus"
DIM = 64
TURN_STEP = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files, be it one file or a folder of them.

    The path is a pattern, as a stream takes a plain path for a folder.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


# -- files ---------------------------------------------------------------


def as_files(documents: DataFrame) -> DataFrame:
    """Documents as files: ``path, text, doc_id, n_chars, lang, source``."""
    folder = F.when(F.col("lang") == "es", "parsed").when(F.col("lang") == "de", "sample_set").otherwise(F.col("lang"))
    dot = F.when(F.col("doc_id") % 10 == 7, ".").otherwise("")
    kinds = F.array(*[F.lit(e) for e in (".md", ".txt", ".pdf", ".docx", ".PDF", ".html")])
    ext = F.get(kinds, (F.col("doc_id") % 6).cast("int"))
    path = F.concat(
        F.lit(f"{ROOT}/"), "source", F.lit("/"), folder, F.lit("/"), dot, F.lit("doc_"), F.col("doc_id").cast("string"), ext
    )
    return documents.select(path.alias("path"), "text", "doc_id", "n_chars", "lang", "source")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "documents"))


FILES = f"""files AS (
  SELECT '{ROOT}/' || source || '/'
      || CASE lang WHEN 'es' THEN 'parsed' WHEN 'de' THEN 'sample_set' ELSE lang END || '/'
      || CASE WHEN doc_id % 10 = 7 THEN '.' ELSE '' END || 'doc_' || doc_id
      || ['.md', '.txt', '.pdf', '.docx', '.PDF', '.html'][(doc_id % 6 + 1)::INT] AS path,
    text, doc_id, n_chars, lang, source
  FROM documents)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a plain corpus, half ``.md`` and half ``.pdf``: ``path, text, doc_id``."""
    path = F.concat(
        F.lit(f"{ROOT}/"),
        "source",
        F.lit("/doc_"),
        F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".pdf"),
    )
    return table(spark, sf_dir, "documents").select(path.alias("path"), "text", "doc_id")


CORPUS = f"""corpus AS (
  SELECT '{ROOT}/' || source || '/doc_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.pdf' END AS path,
    text, doc_id
  FROM documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a page of its own file; each third page gets blank."""
    return (
        table(spark, sf_dir, "documents")
        .select(
            F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
            F.posexplode(F.split("text", "\n")).alias("at", "line"),
        )
        .select(
            "path",
            (F.col("at") + 1).alias("page_number"),
            F.when(F.col("at") % 3 == 2, F.lit("  \n ")).otherwise(F.concat(F.lit(" "), "line", F.lit("\n"))).alias("text"),
        )
    )


# -- paragraphs ----------------------------------------------------------

H2 = ["视频来源", "大纲", "总结"]
H3 = [
    "One-sentence Summary",
    "Takeaways",
    "In-depth Q&A",
    "Key Words and Tags",
    "Target Audience",
    "Terminology Explanation",
    "Remarks",
]


def _para(level: int, text: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), text.alias("text"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript compilations.

    System rows open a video block, user rows a section with a question, assistant
    rows are speech (with a speaker marker) or body text; both end in an aside.
    """
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    at = conv + turn
    body = F.transform(F.split(text, "\n"), lambda x: _para(0, x))
    none = F.slice(F.array(_para(0, F.lit(""))), 1, 0)
    h2 = F.get(F.array(*map(F.lit, H2)), (at % 3).cast("int"))
    h3 = F.get(F.array(*map(F.lit, H3)), (at % 7).cast("int"))
    marker = F.concat(F.lit("说话人"), (turn % 2 + 1).cast("string"), F.lit(": 00:01:05 - 00:02:59"))
    aside = F.array(_para(4, F.concat(F.lit("Aside "), turn.cast("string"))))
    rows = (
        F.when(
            F.col("role") == "system",
            F.concat(
                F.array(
                    _para(1, F.concat(F.lit("Recording "), conv.cast("string"), F.lit("-"), turn.cast("string")))
                ),
                body,
            ),
        )
        .when(
            F.col("role") == "user",
            F.concat(
                F.when(turn % 4 < 2, F.array(_para(2, h2))).otherwise(none),
                F.array(_para(3, h3), _para(0, F.concat(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("?")))),
            ),
        )
        .otherwise(F.concat(F.when(at % 2 == 0, F.array(_para(0, marker))).otherwise(none), body, aside))
    )
    return (
        table(spark, sf_dir, "conversations")
        .select(
            F.concat(F.lit("Volume "), conv.cast("string"), F.lit("_for AI inputs_2026.docx")).alias("path"),
            turn,
            F.posexplode(rows).alias("at", "p"),
        )
        .select(
            "path",
            (F.col("turn") * TURN_STEP + F.col("at")).alias("para_index"),
            F.col("p.level").alias("level"),
            F.col("p.text").alias("text"),
        )
        .where(F.trim("text") != "")
    )


PARAGRAPHS = f"""para_rows AS (
  SELECT conv_id, turn, 'Volume ' || conv_id || '_for AI inputs_2026.docx' AS path,
    CASE role
      WHEN 'system' THEN list_concat(
        [{{'level': 1, 'text': 'Recording ' || conv_id || '-' || turn}}],
        list_transform(string_split(text, chr(10)), lambda x: {{'level': 0, 'text': x}}))
      WHEN 'user' THEN list_concat(
        CASE WHEN turn % 4 < 2 THEN [{{'level': 2, 'text': {H2}[((conv_id + turn) % 3 + 1)::INT]}}] ELSE [] END,
        [{{'level': 3, 'text': {H3}[((conv_id + turn) % 7 + 1)::INT]}},
         {{'level': 0, 'text': replace(text, chr(10), ' ') || '?'}}])
      ELSE list_concat(
        CASE WHEN (conv_id + turn) % 2 = 0
          THEN [{{'level': 0, 'text': '说话人' || (turn % 2 + 1) || ': 00:01:05 - 00:02:59'}}] ELSE [] END,
        list_concat(
          list_transform(string_split(text, chr(10)), lambda x: {{'level': 0, 'text': x}}),
          [{{'level': 4, 'text': 'Aside ' || turn}}]))
    END AS rows
  FROM conversations),
paragraphs AS (
  SELECT path, turn * {TURN_STEP} + k - 1 AS para_index, p.level AS level, p.text AS text
  FROM (SELECT path, turn, unnest(rows) AS p, generate_subscripts(rows, 1) AS k FROM para_rows)
  WHERE trim(p.text) <> '')"""

# The running state of every paragraph, told by plain windows.
ANNOTATED = (
    PARAGRAPHS
    + r""",
flagged AS (
  SELECT *, level <> 1 AND regexp_matches(text, '^说话人\s*\d+\s*:\s*\d[\d:]{3,7}\s*-\s*\d[\d:]{3,7}\s*$') AS is_marker,
    CASE
      WHEN contains(lower(text), 'one-sentence') OR contains(lower(text), 'one sentence') THEN 'one_sentence'
      WHEN contains(lower(text), 'takeaway') THEN 'takeaways'
      WHEN contains(lower(text), 'q&a') OR contains(lower(text), 'q & a') OR contains(lower(text), 'in-depth') THEN 'qa'
      WHEN contains(lower(text), 'key word') OR contains(lower(text), 'keyword') OR contains(lower(text), 'tag') THEN 'keywords'
      WHEN contains(lower(text), 'audience') THEN 'audience'
      WHEN contains(lower(text), 'terminolog') THEN 'terminology'
      ELSE 'body' END AS h3
  FROM paragraphs),
marked AS (
  SELECT *,
    CASE WHEN level = 1 THEN 'body' WHEN is_marker THEN NULL
      WHEN level = 2 THEN CASE WHEN contains(text, '视频来源') THEN 'drop' WHEN contains(text, '大纲') THEN 'outline' ELSE 'body' END
      WHEN level = 3 THEN h3 END AS bucket_mark,
    CASE WHEN is_marker THEN para_index WHEN level IN (1, 2, 3) THEN -1 END AS talk_mark
  FROM flagged),
annotated AS (
  SELECT path, para_index, level, text, is_marker,
    coalesce(max(CASE WHEN level = 1 THEN para_index END) OVER w, -1) AS block_start,
    coalesce(last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w, '') AS title,
    coalesce(last_value(bucket_mark IGNORE NULLS) OVER w, 'body') AS bucket,
    CASE WHEN level = 0 THEN nullif(last_value(talk_mark IGNORE NULLS) OVER w, -1) END AS utterance_start
  FROM marked
  WINDOW w AS (PARTITION BY path ORDER BY para_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sections AS (
  SELECT path, block_start, title, para_index, bucket, text FROM annotated
  WHERE NOT is_marker AND level NOT IN (1, 2, 3) AND utterance_start IS NULL AND bucket <> 'drop'),
spoken AS (
  SELECT a.path, a.block_start, a.utterance_start,
    regexp_extract(m.text, '^说话人\s*(\d+)', 1) AS speaker, a.para_index, a.text
  FROM annotated a JOIN annotated m ON m.path = a.path AND m.para_index = a.utterance_start
  WHERE a.utterance_start IS NOT NULL AND NOT a.is_marker),
utterances AS (
  SELECT path, block_start, utterance_start, speaker,
    '说话人' || speaker || ': ' || string_agg(text, ' ' ORDER BY para_index) AS text
  FROM spoken GROUP BY path, block_start, utterance_start, speaker),
qa_marked AS (
  SELECT path, block_start, para_index, text,
    coalesce(max(CASE WHEN right(rtrim(text), 1) IN ('?', '？') THEN para_index END) OVER (
      PARTITION BY path, block_start ORDER BY para_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS pair_start
  FROM sections WHERE bucket = 'qa'),
qa_pairs AS (
  SELECT path, block_start, pair_start, string_agg(text, chr(10) ORDER BY para_index) AS text
  FROM qa_marked GROUP BY ALL),
summary_pieces AS (
  SELECT path, block_start,
    (list_position(['one_sentence', 'takeaways', 'outline', 'keywords', 'audience'], bucket) - 1)::BIGINT * 1099511627776
      + para_index AS pos, text AS piece
  FROM sections WHERE bucket IN ('one_sentence', 'takeaways', 'outline', 'keywords', 'audience')),
video_labels AS (
  SELECT b.path, b.block_start, b.title,
    coalesce(nullif(rtrim(left(trim(o.one), 120)), ''), nullif(b.title, ''), 'untitled') AS video
  FROM (SELECT path, block_start, max(title) AS title FROM annotated WHERE level <> 1 GROUP BY ALL) b
  LEFT JOIN (SELECT path, block_start, string_agg(text, ' ' ORDER BY para_index) AS one
             FROM sections WHERE bucket = 'one_sentence' GROUP BY ALL) o USING (path, block_start))"""
)

# Greedy packing told piece by piece; {T} marks what depends on the section type.
PACKED = (
    ANNOTATED
    + """,
rules(section_type, target, cap, rank, label) AS (VALUES
  ('summary', 1300, 1950, 0, 'Summary'), ('qa', 1100, 1650, 1, 'Q&A'), ('terminology', 1200, 1800, 2, 'Terminology'),
  ('body', 1300, 1950, 3, 'Body'), ('transcript', 1400, 2000, 4, 'Transcript')),
pieces AS (
  SELECT path, block_start, 'summary' AS section_type, pos, piece FROM summary_pieces
  UNION ALL SELECT path, block_start, 'qa', greatest(pair_start, 0), text FROM qa_pairs
  UNION ALL SELECT path, block_start, bucket, para_index, text FROM sections WHERE bucket IN ('terminology', 'body')
  UNION ALL SELECT path, block_start, 'transcript', utterance_start, text FROM utterances),
cut(path, block_start, section_type, pos, part, done, rest, target, cap, many) AS (
  SELECT path, block_start, section_type, pos, -1, '', trim(piece), target, cap, length(trim(piece)) > cap
  FROM pieces JOIN rules USING (section_type)
  UNION ALL
  SELECT path, block_start, section_type, pos, part + 1, rtrim(left(rest, c)), ltrim(substr(rest, c + 1)), target, cap, many
  FROM (
    SELECT *, CASE WHEN length(rest) <= cap THEN length(rest)
        WHEN contains(substr(rest, low + 1, cap - low), ' ')
          THEN cap - strpos(reverse(substr(rest, low + 1, cap - low)), ' ')
        ELSE cap END AS c
    FROM (SELECT *, floor(cap * 0.6)::INT AS low FROM cut WHERE rest <> ''))),
numbered AS (
  SELECT path, block_start, section_type, pos, part, done AS piece, target, many AND part = 0 AS fresh,
    row_number() OVER (PARTITION BY path, block_start, section_type ORDER BY pos, part) AS n
  FROM cut WHERE part >= 0),
walk(path, block_start, section_type, n, size, chunk_start) AS (
  SELECT path, block_start, section_type, n, length(piece), pos * 1048576 + part FROM numbered WHERE n = 1
  UNION ALL
  SELECT w.path, w.block_start, w.section_type, p.n,
    CASE WHEN p.fresh OR w.size + length(p.piece) + 1 > p.target THEN length(p.piece) ELSE w.size + length(p.piece) + 1 END,
    CASE WHEN p.fresh OR w.size + length(p.piece) + 1 > p.target THEN p.pos * 1048576 + p.part ELSE w.chunk_start END
  FROM walk w JOIN numbered p ON p.path = w.path AND p.block_start = w.block_start
    AND p.section_type = w.section_type AND p.n = w.n + 1),
packed AS (
  SELECT path, block_start, section_type, chunk_start, string_agg(piece, chr(10) ORDER BY n) AS text
  FROM walk JOIN numbered USING (path, block_start, section_type, n) GROUP BY ALL)"""
)

# -- vectors -------------------------------------------------------------


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of its members."""
    means = F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(DIM)])
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy(F.col("label").cast("long").alias("qid"))
        .agg(means.alias("embedding"))
    )


def vector_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


LABEL_SEARCH = """label_queries AS (
  SELECT qid, list(m ORDER BY i) AS v FROM (
    SELECT label::BIGINT AS qid, i, avg(x::DOUBLE) AS m
    FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY qid),
scored AS (
  SELECT qid, vec_id AS chunk_id, embedding::DOUBLE[] AS cv, list_cosine_similarity(v, embedding::DOUBLE[]) AS score
  FROM label_queries, embeddings),
ranked AS (
  SELECT qid, chunk_id, cv, score,
    row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id)::INT AS rank
  FROM scored)"""


def question_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions: ``qid, query, embedding``."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return embed_hashed(asked, "query")


def document_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded by the offline embedder: ``chunk_id, embedding``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return embed_hashed(docs).select("chunk_id", "embedding")


def word_counts_sql(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_words AS (
  SELECT {key} AS id, unnest(string_split_regex(lower({text}), '\\s+')) AS w FROM {source}),
{name}_cells AS (
  SELECT id, cast('0x' || substr(md5(w), 1, 4) AS INT) % {DIM} AS b, count(*) AS n
  FROM {name}_words WHERE w <> '' GROUP BY ALL),
{name} AS (
  SELECT id, list(coalesce(n, 0)::DOUBLE ORDER BY b) AS v
  FROM (SELECT {key} AS id, unnest(range({DIM})) AS b FROM {source}) LEFT JOIN {name}_cells USING (id, b)
  GROUP BY id)"""


QUESTION_SEARCH = (
    word_counts_sql("dv", "documents", "doc_id", "text")
    + ",\n"
    + word_counts_sql("qv", "benchmark", "item_id", "text")
    + """,
scored AS (
  SELECT q.id AS qid, d.id AS chunk_id, list_cosine_similarity(q.v, d.v) AS score FROM qv q, dv d),
ranked AS (
  SELECT qid, chunk_id, score,
    row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id)::INT AS rank
  FROM scored)"""
)

# -- conversations -------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User rows with the assistant row that follows; every fifth turn was cancelled."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    said = rows.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    cancelled = F.col("answer").isNull() | ((F.col("conv_id") + F.col("turn")) % 5 == 0)
    return asked.join(said, ["conv_id", "turn"], "left").select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("turn").alias("turn_id"),
        "question",
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.when(cancelled, "cancel").otherwise("complete").alias("status"),
    )


TURNS = """turns AS (
  SELECT u.conv_id::VARCHAR AS conversation_id, u.turn AS turn_id, u.text AS question, coalesce(a.text, '') AS answer,
    CASE WHEN a.text IS NULL OR (u.conv_id + u.turn) % 5 = 0 THEN 'cancel' ELSE 'complete' END AS status
  FROM (SELECT * FROM conversations WHERE role = 'user') u
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream each turn would have sent."""

    def event(status: str, kind: str, content: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(kind).alias("type"), content.alias("content"))

    def deltas(kind: str, text: Column) -> Column:
        return F.transform(F.split(text, " "), lambda w: event("response", kind, F.concat(w, F.lit(" "))))

    call = F.concat(F.lit("Calling retrieve with args: {'query': '"), "question", F.lit("'}"))
    context = F.concat(F.lit("[1] turn "), F.col("turn_id").cast("string"))
    closing = F.struct(
        F.col("status").alias("status"),
        F.when(F.col("status") == "complete", "completion").otherwise("chat.cancel").alias("type"),
        F.lit("").alias("content"),
    )
    stream = F.concat(
        F.array(event("response", CALL, call), event("function", RETRIEVE, context)),
        deltas(REASONING, F.col("question")),
        deltas(ANSWER, F.col("answer")),
        F.array(closing),
    )
    last = F.col("e.type").isin("completion", "chat.cancel")
    words_in, words_out = F.size(F.split("question", " ")), F.size(F.split("answer", " "))
    return (
        turns(spark, sf_dir)
        .select("conversation_id", "turn_id", "question", "answer", F.posexplode(stream).alias("seq", "e"))
        .select(
            "conversation_id",
            "turn_id",
            F.col("seq").cast("long").alias("seq"),
            "e.status",
            "e.type",
            "e.content",
            F.struct(
                F.col("conversation_id"),
                F.lit(0.0).alias("rating"),
                F.when(F.col("e.type") == "completion", F.substring("question", 1, 60)).alias("title"),
                F.when(last, words_in).otherwise(0).alias("input_tokens_used"),
                F.when(last, words_out).otherwise(0).alias("output_tokens_used"),
            ).alias("metadata"),
        )
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per conversation, opened at a time that follows from its id."""
    seconds = F.col("conv_id") * 7919 % 100_003 + 1_700_000_000
    return (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.count("*").alias("n_rows"))
        .select(F.col("conv_id").cast("string").alias("conversation_id"), F.timestamp_seconds(seconds).alias("created_at"))
    )


SESSIONS = """sessions AS (
  SELECT DISTINCT conv_id::VARCHAR AS conversation_id, conv_id * 7919 % 100003 + 1700000000 AS epoch FROM conversations)"""
