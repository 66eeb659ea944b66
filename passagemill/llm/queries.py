"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import chat, decontaminate, fill_middle, fingerprint, html_extract, language, merkle, mixing, ngram_join, quality, repeats, toxicity, training_order
from passagemill.plans.registry import query


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION_SQL = rf"""WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size, -1) + 2)) AS i
        FROM words, (SELECT DISTINCT size FROM windows))),
found AS (SELECT doc_id, size, i, item FROM places JOIN windows USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

JOIN_SQL = rf"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, min(y)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id"""

_CONTROL = r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|turn\|>|<\|role\|>|<\|end\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>"

CHAT_SQL = rf"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  (7 + sum(23 + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}'))))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.scores(docs, quality.train(docs, labels))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.scores(docs, toxicity.train(docs, labels))


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predictions(docs, language.train(docs))


@query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@query()
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


@query(JOIN_SQL)
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(_table(spark, sf_dir, "documents"))


@query(DECONTAMINATION_SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query()
def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(_table(spark, sf_dir, "documents"))


@query()
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@query(CHAT_SQL)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_control_case(_table(spark, sf_dir, "conversations")))


# bytes of UTF-8 are counted by strlen; a way first climbs its own tree (phase 0), then the tree of all roots (phase 1)
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_FIELDS = " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "{0}", "text"))

MANIFEST_SQL = f"""WITH RECURSIVE rows AS (
  SELECT doc_id, lang, sha256({_FIELDS.format("n_chars")}) AS leaf, sha256({_FIELDS.format("(n_chars + 1)")}) AS other,
    coalesce(xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda s, c: list_reduce(list_concat([xor(s, c)], range(8)), lambda t, k: xor(t >> 1, CASE WHEN t & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 7 = 0, false)
      AND n_chars IS NOT NULL AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n, coalesce('+' || lang, '') AS grp FROM rows),
inner_nodes AS (
  SELECT grp, 0 AS lvl, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT grp, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM inner_nodes WHERE n > 1 GROUP BY grp, lvl, pos // 2, n),
subroots AS (
  SELECT grp, h AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
top_nodes AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top_nodes WHERE n > 1 GROUP BY lvl, pos // 2, n),
ways AS (
  SELECT *, row_number() OVER () AS id FROM placed JOIN (SELECT grp, subroot, pos AS place FROM subroots) USING (grp)),
climb AS (
  SELECT id, grp, 0 AS lvl, 0 AS phase, pos, n, place, CASE WHEN tampered THEN other ELSE leaf END AS node, '' AS proof FROM ways
  UNION ALL
  SELECT c.id, c.grp, CASE WHEN c.n = 1 THEN 0 ELSE c.lvl + 1 END, CASE WHEN c.n = 1 THEN c.phase + 1 ELSE c.phase END,
    CASE WHEN c.n = 1 THEN c.place ELSE c.pos // 2 END, CASE WHEN c.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (c.n + 1) // 2 END, c.place,
    CASE WHEN c.n = 1 THEN c.node WHEN c.pos % 2 = 1 THEN sha256(coalesce(i.h, t.h) || c.node) ELSE sha256(c.node || coalesce(i.h, t.h, '')) END,
    CASE WHEN c.n = 1 THEN c.proof ELSE c.proof || coalesce(i.h, t.h, '') END
  FROM climb c
  LEFT JOIN inner_nodes i ON c.phase = 0 AND c.n > 1 AND i.grp = c.grp AND i.lvl = c.lvl AND i.pos = xor(c.pos, 1)
  LEFT JOIN top_nodes t ON c.phase = 1 AND c.n > 1 AND t.lvl = c.lvl AND t.pos = xor(c.pos, 1)
  WHERE c.phase < 2)
SELECT doc_id, leaf, subroot, (SELECT h FROM top_nodes WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root,
  node = (SELECT h FROM top_nodes WHERE n = 1) AS verified
FROM ways JOIN climb USING (id) WHERE phase = 2"""


@query(MANIFEST_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


# the token pattern of the contract; sha256 gives hexadecimal text
MIDDLE_SQL = r"""WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
hashed AS (
  SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
pieces AS (
  SELECT *, array_to_string(w[1:least(x, y)], '') AS p, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(w[greatest(x, y) + 1:], '') AS s
  FROM hashed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces"""


@query(MIDDLE_SQL)
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


REPEATS_SQL = r"""WITH words AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
texts AS (SELECT id, i, n, string_agg(word, ' ') OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS run FROM spots),
runs AS (SELECT id, i, row_number() OVER (PARTITION BY run ORDER BY id, i) AS place FROM texts WHERE i + 19 <= n),
gone AS (SELECT DISTINCT id, unnest(range(i, i + 20)) AS i FROM runs WHERE place > 1),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM spots ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (id)"""


@query(REPEATS_SQL)
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
