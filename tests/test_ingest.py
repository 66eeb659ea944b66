import json

import pytest
from pyspark.sql import functions as F

from passagemill.operators import audit, chunking, identity
from passagemill.options import IngestOptions
from passagemill.sources import files as files_src
from passagemill.sources import pages as pages_src
from passagemill.sources import sinks
from passagemill.streaming.ingest import append_new


def test_discover_and_read_a_real_tree(spark, tmp_path):
    for name, body in {
        "guides/policy.md": b"keep\r\n\xff",
        "parsed/policy.md": b"skip",
        "guides/Z.MD": b"upper",
        "guides/.hid.md": b"dot",
        "guides/a.html": b"no",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(body)
    root = str(tmp_path)
    scanned = files_src.scan_tree(spark, root)
    assert scanned.where("path like '%.html'").count() == 0
    default = files_src.discover(scanned, root)
    assert sorted(r.path for r in default.select("path").collect()) == [f"{root}/guides/Z.MD", f"{root}/guides/policy.md"]
    assert files_src.discover(scanned, root, include_parsed=True).count() == 3
    texts = {r.path: r.text for r in files_src.read_text(default).collect()}
    assert texts[f"{root}/guides/policy.md"] == "keep\n�"
    assert [r.path for r in files_src.first_files(default.select("path"), 1).collect()] == [f"{root}/guides/Z.MD"]


def test_copies_keep_the_first_path_even_when_it_fails_the_gate(spark):
    bad, good = "x", "plain words here " * 6
    files = spark.createDataFrame(
        [("b.md", bad), ("a.md", bad), ("c.md", good), ("a-b/c.md", good), ("a/z.md", good)], "path string, text string"
    ).withColumn("doc_sha", identity.content_sha(F.col("text")))
    kept, copies = identity.split_copies(files)
    assert sorted(r.path for r in kept.collect()) == ["a.md", "a/z.md"]
    assert {r.path: r.reason for r in copies.collect()} == {
        "b.md": "duplicate content", "c.md": "duplicate content", "a-b/c.md": "duplicate content"
    }
    accepted, rejected = chunking.gate(kept, F.lit(".md"))
    assert [r.path for r in accepted.collect()] == ["a/z.md"]
    assert [(r.path, r.reason) for r in rejected.collect()] == [
        ("a.md", "document parsed to low-quality text (scan/word-soup)")
    ]


def sections(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chunking.header_sections(F.col("t")).alias("s")).first()
    return [(s.headers, s.text) for s in row.s]


def test_header_sections(spark):
    got = sections(spark, "intro\n# A\nx\n  ### C  \ny\n## B\nz\n#no\n##### five\n# A2\n")
    assert got == [
        ([None] * 4, "intro"),
        (["A", None, None, None], "# A\nx"),
        (["A", None, "C", None], "### C\ny"),
        (["A", "B", None, None], "## B\nz\n#no\n##### five"),
        (["A2", None, None, None], "# A2"),
    ]


def test_header_sections_fences_and_equal_paths(spark):
    assert sections(spark, "```\n# in\n~~~\n# A\none\n# A\ntwo") == [
        ([None] * 4, "```\n# in\n~~~"),
        (["A", None, None, None], "# A\none\n# A\ntwo"),
    ]
    assert sections(spark, "```\n# never closed") == [([None] * 4, "```\n# never closed")]
    assert sections(spark, "") == []
    assert sections(spark, "# H") == [(["H", None, None, None], "# H")]


def test_split_to_size_contract():
    split = chunking.split_to_size
    assert split("", 10, 2) == []
    assert split("short", 10, 2) == ["short"]
    # Paragraph breaks first; the overlap is made of whole pieces.
    assert split("aaaa\n\nbbbb\n\ncccc", 12, 6) == ["aaaa\n\nbbbb", "bbbb\n\ncccc"]
    assert split("aaaa\n\nbbbb\n\ncccc", 12, 5) == ["aaaa\n\nbbbb", "cccc"]
    # A long word is cut by characters, with the overlap in characters.
    assert split("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]
    # Pieces keep their separator in front.
    assert split("One. Two. Three", 9, 0) == ["One. Two", ". Three"]


@pytest.mark.parametrize("seed", range(5))
def test_split_to_size_invariants(seed):
    import random

    rng = random.Random(seed)
    # Every stretch of text occurs once, so that parts can be found again.
    tokens = iter(chr(0x4E00 + i) for i in range(20_000))
    text = "".join(
        rng.choice(["", " ", "\n", "\n\n", ". "]) + "".join(next(tokens) for _ in range(rng.choice([1, 4, 9, 40, 90])))
        for _ in range(400)
    )
    parts = chunking.split_to_size(text, 120, 30)
    assert all(0 < len(p) <= 120 for p in parts)
    at = 0
    for part in parts:  # in order; only white space is lost between parts; the overlap is bounded
        start = text.find(part, at if part == "." else max(0, at - 30))
        assert start >= 0
        assert at - start <= 30 and text[at : max(start, at)].strip() == ""
        at = start + len(part)
    assert text[at:].strip() == ""


def test_chunk_documents_numbers_kept_chunks(spark):
    text = "# One\n" + "useful words go here " * 200 + "\n# Two\ntiny\n# Three\n" + "more useful words " * 10
    docs = spark.createDataFrame([("a.md", "sha", text), ("b.md", "shb", "tiny")], "path string, doc_sha string, text string")
    rows = chunking.chunk_documents(docs, IngestOptions()).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert {r.n_chunks for r in rows} == {len(rows)}
    assert {r.headers[0] for r in rows} == {"One", "Three"}
    stamped = chunking.stamp_chunks(chunking.chunk_documents(docs), None).orderBy("chunk_index").first()
    assert (stamped.source_path, stamped.source_dir, stamped.source_ext) == ("a.md", ".", ".md")


def test_pages_to_markdown_counts_blank_pages(spark):
    pages = spark.createDataFrame(
        [("d/My file.pdf", 3, " c "), ("d/My file.pdf", 1, "a"), ("d/My file.pdf", 2, " \n"), ("e.pdf", 1, "")],
        "path string, page_number int, text string",
    )
    got = {r.path: r.text for r in pages_src.pages_to_markdown(pages).collect()}
    assert got == {"d/My file.pdf": "# My file\n\n## Page 1\n\na\n\n## Page 3\n\nc", "e.pdf": "# e"}


def test_write_append_delete(spark, tmp_path):
    rows = spark.createDataFrame([("a", ".md", "d1"), ("b", ".pdf", "d1"), ("c", ".pdf", None)], "text string, source_ext string, source_dir string")
    table, after = str(tmp_path / "t"), str(tmp_path / "u")
    sinks.write_chunks(rows, table, drop_old=True)
    sinks.write_chunks(rows, table)
    assert spark.read.parquet(table).count() == 6
    sinks.write_chunks(rows, table, drop_old=True)
    assert spark.read.parquet(table).count() == 3
    sinks.replace_partitions(spark.createDataFrame([("n", ".md", "d2")], rows.schema), table)
    assert sorted(r.text for r in spark.read.parquet(table).collect()) == ["b", "c", "n"]
    sinks.replace_partitions(rows.where("source_ext = '.md'"), table)
    sinks.rewrite_without(spark, table, after, (F.col("source_dir") == "d1") & (F.col("source_ext") == ".pdf"))
    assert sorted(r.text for r in spark.read.parquet(after).collect()) == ["a", "c"]


def test_tree_goes_by_its_own_rule_and_streams_new_files(spark, tmp_path):
    import os
    import time

    root = tmp_path / "in"

    def put(name, body=b"x", age=10):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
        os.utime(root / name, (time.time() - age,) * 2)

    for k in range(40):
        put(f"d{k % 7}/e{k % 3}/f{k}.md", b"%d" % k)
    for name in ("_a/x.md", ".b/y.TXT", "_z.md", ".dot.md", "c/.dot.md", "c/no.html"):
        put(name)
    names = lambda df: sorted(r.path[len(str(root)) + 1 :] for r in df.select("path").collect())
    plain = sorted([f"d{k % 7}/e{k % 3}/f{k}.md" for k in range(40)] + ["_a/x.md", ".b/y.TXT", "_z.md"])
    listed = files_src.scan_tree(spark, str(root), content=False)
    assert listed.columns == ["path", "modificationTime", "length"] and names(listed) == plain
    assert names(files_src.scan_tree(spark, f"file://{root}", hidden=True)) == sorted([*plain, ".dot.md", "c/.dot.md"])
    assert {bytes(r.content) for r in files_src.scan_tree(spark, str(root)).where("path like '%/f%'").collect()} == {b"%d" % k for k in range(40)}
    assert files_src.scan_tree(spark, str(tmp_path / "none")).count() == 0

    def batch():
        stream = files_src.stream_tree(spark, str(root), content=False).writeStream.format("parquet")
        stream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return names(spark.read.parquet(str(tmp_path / "out")))

    assert batch() == plain
    time.sleep(1.2)
    put("_a/new/n.md", age=-0.0)
    time.sleep(1.2)
    assert batch() == sorted([*plain, "_a/new/n.md"])


def test_append_new_is_repeatable(spark, tmp_path):
    target = str(tmp_path / "t")
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "path string, doc_sha string")
    append_new(files, target)
    append_new(files, target)
    append_new(spark.createDataFrame([("d", "2"), ("e", "3")], "path string, doc_sha string"), target)
    assert sorted(r.path for r in spark.read.parquet(target).collect()) == ["a", "c", "e"]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from passagemill.streaming.ingest import ledger_of, read_committed

    target = str(tmp_path / "t")
    one = spark.createDataFrame([("a", "0" * 64), ("b", "0" * 64), ("c", "1" * 64)], "path string, doc_sha string")
    two = spark.createDataFrame([("d", "1" * 64), ("e", "2" * 64)], "path string, doc_sha string")

    def state():
        hashes = sorted((r.batch, r.path, r.doc_sha[0], r.bucket) for r in ledger_of(target).hashes(spark).collect())
        return sorted((r.batch, r.path) for r in read_committed(spark, target).collect()), hashes

    append_new(one, target, batch="1")
    append_new(two, target, batch="2")
    want = state()
    assert want[0] == [("1", "a"), ("1", "c"), ("2", "e")]
    assert want[1] == [("1", "a", "0", "b00"), ("1", "c", "1", "b11"), ("2", "e", "2", "b22")]
    for name, files in (("1", one), ("2", two), ("1", one)):
        append_new(files, target, batch=name)
        assert state() == want
    # a batch that broke off after its rows were written is not seen, and takes its files when it runs again
    spark.createDataFrame([("f", "3" * 64, "3")], "path string, doc_sha string, batch string").write.mode("append").partitionBy("batch").parquet(target)
    assert state() == want
    append_new(spark.createDataFrame([("f", "3" * 64), ("g", "2" * 64)], "path string, doc_sha string"), target, batch="3")
    assert state()[0] == [*want[0], ("3", "f")]


def test_filters_know_every_hash_and_few_others(spark, tmp_path):
    from passagemill.streaming.ledger import Ledger

    ledger = Ledger(str(tmp_path / "ledger"), digits=1)
    keys = spark.range(3000).select(F.col("id").cast("string").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("doc_sha"))
    ledger.commit(keys.where("path < 1000"), "x")
    ledger.commit(keys.where("path >= 1000 and path < 2000"), "y")
    known = {r.doc_sha for r in ledger.known(keys, "z").collect()}
    assert known == {r.doc_sha for r in keys.where("path < 2000").collect()}
    assert {r.doc_sha for r in ledger.known(keys, "y").collect()} == {r.doc_sha for r in keys.where("path < 1000").collect()}
    assert Ledger(str(tmp_path / "none")).known(keys, "z").count() == 0


def test_stats_sample_and_manifest(spark, tmp_path):
    chunks = spark.range(10).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.repeat(F.lit("ab "), F.col("id").cast("int") + 1).alias("text"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"),
    )
    stats = audit.corpus_stats(chunks).first()
    assert (stats.chunks, stats.chunk_chars_min, stats.chunk_chars_avg, stats.chunk_chars_max) == (10, 3, 16, 30)
    for sample, want in ((3, [0, 3, 6]), (1, [0]), (20, list(range(10))), (0, [])):
        got = audit.sample_chunks(chunks, sample)
        assert sorted(r.doc_id for r in got.collect()) == want
    files = spark.createDataFrame(
        [("p1", "p1", "c", "s1", None), ("p99", "p99", "c", "s2", "duplicate content")],
        "path string, name string, category string, doc_sha string, reason string",
    )
    summary = audit.file_summary(files, chunks)
    records = audit.manifest_records(summary, audit.corpus_stats(chunks), {"dry_run": False, "root": "/r"})
    sinks.write_manifest(records, str(tmp_path / "m"))
    by_kind = {r.kind: json.loads(r.value) for r in spark.read.text(str(tmp_path / "m")).collect()}
    assert by_kind["run"]["totals"]["files_ingested"] == 1
    assert by_kind["run"]["totals"]["files_skipped"] == 1
    assert by_kind["run"]["totals"]["chunks"] == 10
    assert by_kind["file"] == {"category": "c", "chunks": 1, "name": "p1", "path": "p1", "sha256": "s1"}
    assert by_kind["skipped"] == {"name": "p99", "path": "p99", "reason": "duplicate content"}


def test_delete_in_place_leaves_other_partitions_alone(spark, tmp_path):
    from pathlib import Path

    from pyspark.sql import functions as F

    table = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", ".md"), ("b", ".pdf"), ("c", ".pdf"), ("d", ".txt")], "path string, source_ext string")
    sinks.write_chunks(rows, table, drop_old=True)
    files = {p for p in Path(table).rglob("*.parquet") if ".md" in str(p)}
    assert sinks.delete_in_place(spark, table, F.col("path").isin("b", "d")) == [".pdf", ".txt"]
    assert sorted(r.path for r in spark.read.parquet(table).collect()) == ["a", "c"]
    assert {p for p in Path(table).rglob("*.parquet") if ".md" in str(p)} == files
    assert sinks.delete_in_place(spark, table, F.col("path") == "zz") == []


@pytest.mark.parametrize("cell_paths", [1, 4, 10_000])
def test_sample_refines_cells_until_they_are_small(spark, cell_paths):
    import random

    rng = random.Random(cell_paths)
    names = {f"{rng.choice(['a', 'a/b', 'ab', 'é'])}/{'x' * rng.randrange(4)}{rng.randrange(50)}.md" for _ in range(120)} | {"a", "a/b", "x" * 40, "x" * 40 + "y"}
    rows = [(name, k) for name in names for k in range(rng.randrange(1, 5))]
    chunks = spark.createDataFrame(rows, "path string, chunk_index int")
    in_order = sorted(rows, key=lambda r: (r[0].split("/"), r[1]))
    for sample in (3,) if cell_paths < 10_000 else (1, 7, len(rows) + 5):
        step = max(1, len(rows) // sample)
        want = [(*in_order[k * step], k * step) for k in range(sample) if k * step < len(rows)]
        got = [(r.path, r.chunk_index, r.place) for r in audit.sample_chunks(chunks, sample, cell_paths).orderBy("place").collect()]
        assert got == want


def test_incremental_runs_remember_files_without_chunks(spark, tmp_path):
    from pyspark.sql import functions as F

    from passagemill.streaming.ingest import append_new

    target = str(tmp_path / "t")
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "path string, doc_sha string")
    asked = []

    def build(df):
        asked.append(sorted(r.path for r in df.collect()))
        return df.where(F.col("doc_sha") == "1")

    append_new(files, target, build)
    append_new(files, target, build)
    assert asked == [["a", "b"], []]
    assert [r.path for r in spark.read.parquet(target).collect()] == ["a"]
    bare = str(tmp_path / "bare")
    spark.range(1).write.parquet(bare)
    with pytest.raises(Exception, match="doc_sha"):
        append_new(files, bare, build)


def test_sectioning_is_linear_and_windows_have_a_stride():
    import time

    from passagemill.operators.chunking import sections_of, split_to_size

    def seconds(n):
        start = time.perf_counter()
        assert len(sections_of([""] + [f"## h{i}\nx" for i in range(n)])) == n
        return time.perf_counter() - start

    seconds(1000)
    assert min(seconds(80_000) for _ in range(3)) < 6 * min(seconds(20_000) for _ in range(3))
    text = "".join(chr(0x4E00 + i) for i in range(5000))
    parts = split_to_size(text, 1800, 250)
    assert parts == [text[0:1800], text[1550:3350], text[3100:4900], text[4650:]]


def test_delete_rewrites_only_files_with_hits(spark, tmp_path):
    table = str(tmp_path / "t")
    for k in range(4):
        rows = [(f"f{k}-{i}", ".md" if i % 2 else ".pdf") for i in range(6)]
        spark.createDataFrame(rows, "path string, source_ext string").coalesce(1).write.mode("append").partitionBy("source_ext").parquet(table)

    def files():
        return {p.relative_to(table): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}

    before = files()
    assert sinks.delete_in_place(spark, table, F.col("path").isin("f1-1", "f2-0", "f2-2", "f2-4")) == [".md", ".pdf"]
    after = files()
    assert len(before) == 8 and len(before.items() & after.items()) == 6  # one .md file and one .pdf file went
    assert len(after) == 7  # the .pdf file lost all its rows
    want = {f"f{k}-{i}" for k in range(4) for i in range(6)} - {"f1-1", "f2-0", "f2-2", "f2-4"}
    assert sorted(r.path for r in spark.read.parquet(table).collect()) == sorted(want)
    assert sinks.delete_in_place(spark, table, F.col("source_ext") == ".pdf") == [".pdf"]
    assert not list((tmp_path / "t").glob("source_ext=.pdf")) and {r.source_ext for r in spark.read.parquet(table).collect()} == {".md"}


def test_a_stream_reads_a_table_of_one_file_or_a_folder(spark, tmp_path):
    from passagemill.plans import ingest

    body = " of the words that a longer page has, so that it is kept" * 12
    docs = [(1, "one" + body, "en", "s", 3), (2, "two" + body, "de", "s", 3), (3, "two" + body, "fr", "s", 3), (4, "three" + body, "es", "s", 5)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    (tmp_path / "file").mkdir()
    rows.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    for kind in ("folder", "file"):
        got = ingest.ingest_incremental(spark, str(tmp_path / kind)).collect()
        assert sorted(r.path for r in got) == ["/corpus/s/en/doc_1.txt", "/corpus/s/fr/doc_3.docx", "/corpus/s/parsed/doc_4.PDF"]
    replayed = ingest.ingest_replay(spark, str(tmp_path / "folder")).collect()
    assert len(replayed) == 3 and all(r.as_in_one_run for r in replayed)


def test_parts_of_a_text_that_repeats_itself_have_their_places(spark, tmp_path):
    from passagemill.operators.chunking import split_spans, split_to_size
    from passagemill.plans import ingest

    line = "the same line again and again, of eighty letters or so, until the page is full.."
    texts = ["\n".join([line] * 60), line * 60, "ab" * 3000, "x \n" * 2000, "short"]
    (tmp_path / "documents.parquet").mkdir()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in ingest.recursive_chunks(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        assert got[k].solid_covered == len(text.replace(" ", "").replace("\n", ""))
        assert got[k].overlaps_bounded and got[k].all_within_size
        spans = list(split_spans(text.strip(), 1800, 250))
        assert [text.strip()[a:b] for a, b in spans] == split_to_size(text.strip(), 1800, 250)
    wrong = spark.createDataFrame([(texts[0], [texts[0][:100], texts[0][300:]])], "text string, parts array<string>")
    assert wrong.select(ingest.places(1800, 250)("text", "parts").alias("p")).first().p.bounded is False


def test_batches_of_python_workers_are_bounded(spark):
    import pyarrow as pa

    from passagemill.functions.batches import LIMITS
    from passagemill.functions.embed import embed_hashed

    @F.arrow_udf("long")
    def rows_of_batch(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int64())

    own = spark.newSession()
    for use in (lambda df: chunking.chunk_arrays(df), lambda df: embed_hashed(df)):
        for key in LIMITS:
            own.conf.unset(key)
        rows = own.range(0, 5_000, 1, 1).selectExpr("id", "repeat('word ', 2000) as text")
        use(rows)
        assert rows.select(rows_of_batch("id").alias("n")).agg(F.max("n")).first()[0] <= 1_000
        assert rows.select("id", rows_of_batch(F.length("text")).alias("n"), rows_of_batch("text").alias("m")).agg(F.max("m")).first()[0] <= 500
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    embed_hashed(own.createDataFrame([("x",)], "text string"))
    assert own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77"


def test_one_worker_sections_and_cuts(spark):
    body = "# One\n" + "alpha beta gamma delta " * 200 + "\n## Two\n" + "some other words that are kept here " * 9
    rows = spark.createDataFrame([("a", body), ("b", None), ("c", "")], "path string, text string")
    made = chunking.chunk_arrays(rows)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.path: r["_chunks"] for r in made.collect()}
    assert got["b"] == [] and got["c"] == []
    told = [(c.headers, c.text) for c in got["a"]]
    sections = [s for s in rows.where("path = 'a'").select(chunking.header_sections(F.col("text")).alias("s")).first().s]
    assert told == [(s.headers, part) for s in sections for part in chunking.split_to_size(s.text, 1800, 250) if sum(map(str.isalnum, part)) >= 60]
    assert len(told) >= 4


def test_a_folder_is_read_in_small_batches(monkeypatch):
    from datetime import datetime, timezone

    from passagemill.sources import tree

    now = datetime.now(timezone.utc)
    large = list(tree.batches(((f"f{k}", now, 1 << 20, b"x") for k in range(10)), True))
    assert [b.num_rows for b in large] == [4, 4, 2]
    small = list(tree.batches(((f"f{k}", now, 1 << 20) for k in range(2_500)), False))
    assert [b.num_rows for b in small] == [1_000, 1_000, 500] and small[0].schema.names == ["path", "modificationTime", "length"]
