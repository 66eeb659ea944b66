"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.llm import chat, decontaminate, fill_middle, fingerprint, html_extract, language, merkle, mixing, ngram_join, quality, repeats, toxicity, training_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside themselves
CLASH = ["score", "size", "place", "row", "_row", "spans", "items", "slice", "copy", "key", "class", "hash", "h", "epochs", "taken", "target", "part", "number", "host", "uid", "g", "digest", "leaf", "presented", "tree", "block", "pos", "total", "witness", "kind", "data", "extra", "form", "output", "tie"]


def prose(k, n=60):
    return " ".join(f"w{(k * 7919 + i * i) % 1_000_003}" for i in range(n))


ROWS = [
    (1, prose(1), "en", "a", 1),
    (2, prose(1), "en", "a", 1),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (None, prose(4), "de", "a", 1),
    (5, "One two", "de", "b", 7),
    (5, "One two", "de", "b", 7),
    (6, "x" * 30_000 + " " + prose(6, 3000), "en", "a", 1),
    (7, "%%% 123", "en", "b", 7),
    (8, "é", "fr", "c", 1),
]


def clashing(df):
    for name in CLASH:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, SCHEMA)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2 == 0), int(i == 1)) for i in range(1, 9)] + [(1, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark_items(spark):
    text = " ".join(prose(6, 3000).split()[100:130])
    return spark.createDataFrame([(1, text.upper()), (2, "one TWO"), (3, None), (4, "..."), (2, "one two"), (None, "one two")], "item_id long, text string")


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


WANT = sorted((r[0] is None, r[0] or 0) for r in ROWS)


def test_scores_cover_every_row(docs, labels):
    for scored in (quality.scores(docs, quality.train(docs, labels)), toxicity.scores(docs, toxicity.train(docs, labels))):
        rows = scored.collect()
        assert ids(scored) == WANT and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1


@pytest.mark.parametrize("keep", ["doc_id < 0", "doc_id = 1"])
def test_models_without_or_with_one_label(docs, labels, keep):
    few = labels.where(keep)
    forest, model = quality.train(docs, few), toxicity.train(docs, few)
    assert quality.scores(docs, forest).count() == len(ROWS)
    assert toxicity.scores(docs, model).count() == len(ROWS)


def test_language(docs):
    got = {r.doc_id: r for r in language.predictions(docs, language.train(docs)).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[7].lang_pred == "und" and got[7].score == 0
    assert got[8].lang_pred != "und"
    assert {r.lang_pred for r in language.predictions(docs, language.train(docs.limit(0))).collect()} == {"und"}


def test_decontamination(docs, benchmark_items):
    got = {r.doc_id: r for r in decontaminate.report(docs, benchmark_items).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[5].n_words, got[5].n_hit, got[5].n_items, got[5].items_sha256) == (2, 2, 2, sha(",2"))
    assert (got[6].n_hit, got[6].n_items, got[6].contaminated) == (30, 1, True)
    assert (got[3].n_words, got[3].items_sha256, got[3].contaminated) == (0, sha(""), False)
    cut = decontaminate.cleaned(docs, benchmark_items)
    assert cut.schema.names == docs.schema.names
    rows = cut.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 2, 3, 4, 6, 7, 8]
    six = next(r for r in rows if r.doc_id == 6)
    words = prose(6, 3000).split()
    assert six.text == "x" * 30_000 + " " + " ".join(words[:100] + words[130:]) and six.n_chars == len(six.text)
    assert decontaminate.report(docs.limit(0), benchmark_items).count() == 0
    assert decontaminate.report(docs, benchmark_items.limit(0)).where("contaminated").count() == 0


def test_join(docs):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 58, 1), (2, 58, 1), (3, 0, 3), (4, 0, 4), (None, 58, None), (5, 1, 5), (5, 1, 5), (6, len({*zip(*(ROWS[7][1].split()[k:] for k in range(3)))}), 6), (7, 1, 7), (8, 1, 8)], key=str)
    kept = ngram_join.one_of_each(docs)
    assert kept.schema.names == docs.schema.names
    assert ids(kept) == sorted((i is None, i or 0) for i in (1, 3, 4, None, 5, 6, 7, 8))
    assert ngram_join.linked(docs.limit(0)).count() == 0


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == WANT
    assert all(r.taken in (k * r.size for k in range(4)) for r in rows)
    mixed = mixing.mixed(docs)
    assert mixed.schema.names == docs.schema.names
    assert mixed.count() == sum(r.taken // r.size for r in rows if r.size) + mixed.where("coalesce(text, '') = ''").count()
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_training_order(docs):
    options = training_order.OrderOptions(length=64, shard=8)
    rows = training_order.training_order(docs, options).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert all(len(r.tokens) == 128 and r.place == (r.slot % 8) * 128 and r.shard == r.slot // 8 for r in rows)
    assert {i for r in rows for i in r.doc_ids} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert training_order.training_order(docs.limit(0), options).count() == 0


def test_fingerprints(docs):
    got = fingerprint.fingerprints(docs).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and by_id[1].fingerprint == by_id[2].fingerprint != by_id[None].fingerprint
    assert by_id[2].near_next == 1.0 and all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    one = fingerprint.fingerprints(docs.where("doc_id = 8")).collect()
    assert one[0].near_next == 1.0 and one[0].n_chars == 1
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_manifest(docs):
    rows = merkle.audit(docs).collect()
    assert ids(merkle.audit(docs)) == WANT and len({r.root for r in rows}) == 1
    assert len({r.subroot for r in rows}) == 4  # null, de, en, fr
    five = [r for r in rows if r.doc_id == 5]
    assert five[0].leaf == five[1].leaf
    assert merkle.audit(docs.limit(0)).count() == 0
    one = merkle.audit(docs.where("doc_id = 4")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified
    assert one.leaf == hashlib.sha256(b"1:41:b-1:00:").hexdigest() and one.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_repeats(docs):
    got = {r.doc_id: r for r in repeats.repeats(docs).collect()}
    assert ids(repeats.repeats(docs)) == WANT
    assert (got[1].n_removed, got[2].n_removed, got[2].kept) == (0, 60, "")
    assert (got[3].n_words, got[4].n_words, got[3].kept) == (0, 0, "") and got[6].n_words == 3001
    assert got[5].n_removed == 0 and got[5].kept == "One two"  # repeated, but shorter than a window
    again = docs.unionByName(docs.where("doc_id is null"))
    assert sorted(r.n_removed for r in repeats.repeats(again).where("doc_id is null").collect()) == [0, 60]
    assert repeats.repeats(docs.limit(0)).count() == 0


def test_middles(docs):
    got = {r.doc_id: r for r in fill_middle.digests(docs).collect()}
    assert ids(fill_middle.digests(docs)) == WANT
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    assert all(got[r[0]].restored_sha256 == sha(r[1]) for r in ROWS)
    assert got[3].form == got[4].form == "plain" and got[3].prefix_chars is None and got[6].n == 3001
    assert fill_middle.digests(docs.limit(0)).count() == 0


def test_pages(spark):
    page = "<html><body><nav>menu</nav><article><h1>T &amp; T</h1><p>one<p>two<br>three</article><footer>f</footer></body></html>"
    rows = [(1, "http://a/x", page), (1, "http://a/x", page), (2, None, None), (3, "http://a/y", ""), (None, "b", "<p>plain</p>"), (5, "http://a/z", "<article>" + "<p>z</p>" * 20_000)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert html_extract.extract(df).count() == 6
    assert got[1].text == "T & T\none\ntwo three" and got[1].n_chars == 19
    assert (got[2].text, got[3].text, got[None].text, got[5].n_chars) == ("", "", "plain", 39_999)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "assistant", "é"), (2, None, "assistant", "<|end|>\\"), (3, 0, "user", "y" * 100_000)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (3, sha("user\n\n\nx\n\nx\n"), 0)
    assert (got[None].n_turns, got[None].loss_chars) == (1, 1)
    assert (got[2].loss_sha256, got[2].loss_chars) == (sha("<|end|>\\"), 8)
    assert chat.digests(df.limit(0)).count() == 0
    text = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert all(chat.unescape(text[2].text[a:b]) == "<|end|>\\" for a, b in text[2].loss)


def test_stages_keep_the_columns(spark, docs, labels, benchmark_items, tmp_path):
    import corpus_pipeline

    docs.drop(*CLASH).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark_items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_delete_what_earlier_ones_staged(spark, docs, labels, benchmark_items, tmp_path):
    import corpus_pipeline
    from passagemill.llm import common

    with common.noted_tables() as outer:
        with common.noted_tables() as inner:
            kept = common.staged(spark.range(3))
        gone = common.staged(spark.range(2))
    assert len(inner) == 1 and len(outer) == 2 and set(inner) < set(outer)
    assert common.drop_tables(spark, outer, unless_read_by=kept) == inner and kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(next(f for f in outer if f not in inner)).count()
    del gone
    docs.drop(*CLASH).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark_items.write.parquet(f"{tmp_path}/benchmark.parquet")
    corpus_pipeline.run(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    last = list(corpus_pipeline._scratch)
    assert last and all(spark.read.parquet(f) is not None for f in last)
    corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert not set(last) & set(corpus_pipeline._scratch)
