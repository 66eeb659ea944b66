import json

import pytest
from pyspark.sql import functions as F

from passagemill import jobs
from passagemill.functions.models import replier
from passagemill.functions.prompts import question_prompt
from passagemill.operators.carry import number_rows
from passagemill.options import IngestOptions, RetrievalOptions

GOOD = "plain useful words go here again. " * 120


@pytest.fixture
def files(spark):
    rows = [
        ("/k/a/one.md", "# Top\n" + GOOD),
        ("/k/a/copy.md", "# Top\n" + GOOD),
        ("/k/b/two.txt", "Another text. " + GOOD),
        ("/k/b/bad.pdf", "too short"),
    ]
    return spark.createDataFrame(rows, "path string, text string")


def by_kind(records):
    out = {}
    for r in records.collect():
        out.setdefault(r.kind, []).append(json.loads(r.record))
    return out


def test_ingest_writes_chunks_and_manifest(spark, files, tmp_path):
    target = str(tmp_path / "chunks")
    result = jobs.ingest(files, target, "/k", manifest=str(tmp_path / "manifest"))
    told = by_kind(result.records)
    totals = told["run"][0]["totals"]
    stored = spark.read.parquet(target)
    assert totals["files_discovered"] == 4 and totals["files_ingested"] == 2 and totals["files_skipped"] == 2
    assert totals["chunks"] == totals["chunks_written"] == stored.count() > 4
    assert totals["chunk_chars_max"] <= 1800
    assert {r["path"]: r["reason"] for r in told["skipped"]} == {
        "a/one.md": "duplicate content",
        "b/bad.pdf": "document parsed to low-quality text (scan/word-soup)",
    }
    assert {r["path"]: r["category"] for r in told["file"]} == {"a/copy.md": "a", "b/two.txt": "b"}
    first = stored.where("name = 'copy.md' and chunk_index = 0").first()
    assert first.headers[0] == "Top" and first.source_path == "a/copy.md" and len(first.embedding) == 64
    assert stored.select("chunk_id").distinct().count() == stored.count()
    assert {r.kind for r in spark.read.text(str(tmp_path / "manifest")).select("kind").collect()} == {"run", "file", "skipped"}
    # The same ids again: a second append doubles rows, not ids.
    jobs.ingest(files, target, "/k")
    again = spark.read.parquet(target)
    assert again.count() == 2 * stored.select("chunk_id").distinct().count() == 2 * totals["chunks"]


def test_dry_run_samples_and_writes_nothing(files, tmp_path):
    target = tmp_path / "chunks"
    result = jobs.ingest(files, str(target), "/k", IngestOptions(dry_run=True, sample=2, category="all"))
    assert not target.exists()
    assert result.sample.count() == 2
    told = by_kind(result.records)
    assert "chunks_written" not in told["run"][0]["totals"] and told["run"][0]["dry_run"] is True
    assert {r["category"] for r in told["file"]} == {"all"}


def test_limit_and_empty_corpus(files, tmp_path):
    told = by_kind(jobs.ingest(files, str(tmp_path / "t"), "/k", IngestOptions(limit=1)).records)
    assert [r["path"] for r in told["file"]] == ["a/copy.md"] and "skipped" not in told
    with pytest.raises(ValueError, match="no chunks produced"):
        jobs.ingest(files.where("path like '%bad%'"), str(tmp_path / "u"), "/k")


def test_compilations_route_by_template(spark):
    say = "Words about the fire alarm design and the grounding of rooms. "
    rows = [
        ("t_for AI inputs_1.docx", 0, 1, "Video"),
        ("t_for AI inputs_1.docx", 1, 2, "总结"),
        ("t_for AI inputs_1.docx", 2, 0, say * 30),
        ("t_for AI inputs_1.docx", 3, 0, "说话人1: 00:01:05 - 00:02:59"),
        ("t_for AI inputs_1.docx", 4, 0, say * 30),
        ("empty.docx", 0, 2, "大纲"),
        ("empty.docx", 1, 0, "short"),
        ("plain.docx", 0, 1, "Head"),
        ("plain.docx", 1, 0, say * 60),
        ("low.docx", 0, 0, "x"),
    ]
    paragraphs = spark.createDataFrame(rows, "path string, para_index long, level int, text string")
    shas = paragraphs.select("path").distinct().withColumn("doc_sha", F.col("path"))
    chunks = jobs.compilation_chunks(paragraphs, shas, None).cache()
    typed = chunks.where("parser = 'docx-structured'").orderBy("chunk_index").collect()
    assert [c.section_type for c in typed] == ["body", "transcript"]
    assert [(c.chunk_index, c.n_chunks) for c in typed] == [(0, 2), (1, 2)]
    assert typed[0].text.startswith("t › Video › Body\n\nWords") and typed[0].video_title == "Video"
    plain = chunks.where("parser = 'docx-markdown'").collect()
    assert {c.path for c in plain} == {"plain.docx"} and plain[0].headers[0] == "Head" and plain[0].section_type is None
    reasons = {r.path: r.reason for r in jobs.compilation_outcomes(paragraphs, chunks).collect()}
    assert reasons == {
        "t_for AI inputs_1.docx": None,
        "empty.docx": "template docx produced no usable chunks",
        "plain.docx": None,
        "low.docx": "document parsed to low-quality text (scan/word-soup)",
    }


def test_number_rows(spark):
    rows = [("a", b, i) for b in (2, 1) for i in (5, 3, 4)] + [("z", 9, 9)]
    got = number_rows(spark.createDataFrame(rows, "k string, b int, i int"), ["k"], ["b"], ["i"], "n", "total")
    assert sorted((r.k, r.n, r.b, r.i, r.total) for r in got.collect()) == [
        ("a", 0, 1, 3, 6), ("a", 1, 1, 4, 6), ("a", 2, 1, 5, 6), ("a", 3, 2, 3, 6), ("a", 4, 2, 4, 6), ("a", 5, 2, 5, 6), ("z", 0, 9, 9, 1)
    ]


def test_replier_turns_failures_into_nulls(spark):
    def make():
        def model(prompt):
            if "bad" in prompt:
                raise RuntimeError("model offline")
            return "Q: " + prompt[-9:]

        return model

    df = spark.createDataFrame([("fine",), ("bad",), (None,)], "text string")
    got = [r.q for r in df.select(replier(make)(question_prompt(F.col("text"))).alias("q")).collect()]
    assert got == ["Q: Question:", None, None]


def test_recall_evaluation_job(spark):
    texts = {1: "a" * 60 + "snippet one " * 20, 2: "b" * 60 + "snippet two " * 20, 3: "c" * 300}
    sample = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "pk long, text string, source string")
    questions = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, None)], "pk long, question string")
    collection = spark.createDataFrame(
        [(1, [1.0, 0.0], "n", "o", ["h"], texts[1]), (2, [0.0, 1.0], "n", "o", ["h"], "other")],
        "chunk_id long, embedding array<float>, name string, original_filename string, headers array<string>, text string",
    )

    def found(asked):
        return jobs.contexts(asked.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5))), collection, RetrievalOptions(top_k=1))

    details, summary = jobs.recall_evaluation(sample, questions, found)
    assert {r.qid: r.hit for r in details.collect()} == {1: True, 2: False}
    assert tuple(summary.first()) == (1, 2, 50.0)


def test_scratch_folders_lie_in_the_shared_folder(spark):
    from passagemill.sources.sinks import scratch_dir

    class Conf:
        def __init__(self, value, master):
            self.value, self.master = value, master

        def get(self, key, default=None):
            return {"spark.checkpoint.dir": self.value, "spark.master": self.master}[key] or default

    class Session:
        def __init__(self, value, master="local[8]"):
            self.conf = Conf(value, master)

    assert scratch_dir(Session("hdfs://shared/cp/"), "x").startswith("hdfs://shared/cp/x-")
    with pytest.raises(ValueError):
        scratch_dir(Session(None, "spark://host:7077"), "x")
    one, two = scratch_dir(Session(None), "x"), scratch_dir(Session(None), "x")
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]


def test_mixed_corpus_in_one_run(spark, tmp_path):
    say = "Words about the rain garden and the soil of roofs. "
    rows = [
        ("/k/a/one.md", GOOD.encode(), GOOD), ("/k/a/two.md", GOOD.replace(" ", "\r\n").encode(), GOOD.replace(" ", "\n")),
        ("/k/b/three.md", GOOD.replace(" ", "\n").encode(), GOOD.replace(" ", "\n")),
        ("/k/c/deck.pdf", b"pdf", None), ("/k/d/talk_for AI inputs_1.docx", b"docx", None), ("/k/d/same.docx", b"docx", None),
    ]
    files = spark.createDataFrame(rows, "path string, content binary, text string")
    pages = spark.createDataFrame([("/k/c/deck.pdf", 1, GOOD)], "path string, page_number int, text string")
    paragraphs = spark.createDataFrame(
        [("/k/d/talk_for AI inputs_1.docx", i, l, x) for i, (l, x) in enumerate([(1, "Video"), (2, "总结"), (0, say * 30)])],
        "path string, para_index long, level int, text string",
    )
    paragraphs = paragraphs.unionByName(paragraphs.withColumn("path", F.lit("/k/d/same.docx")))
    target = str(tmp_path / "chunks")
    told = by_kind(jobs.ingest(files, target, "/k", pages=pages, paragraphs=paragraphs).records)
    assert {r["path"]: r["reason"] for r in told["skipped"]} == {"d/talk_for AI inputs_1.docx": "duplicate content"}
    # line ends make other contents: bytes count, not decoded texts
    assert {r["path"] for r in told["file"]} == {"a/one.md", "a/two.md", "b/three.md", "c/deck.pdf", "d/same.docx"}
    stored = spark.read.parquet(target)
    assert {(r.name, r.parser) for r in stored.select("name", "parser").distinct().collect()} == {
        ("one.md", "text"), ("two.md", "text"), ("three.md", "text"), ("deck.pdf", "pymupdf4llm"), ("same.docx", "docx-structured")
    }
    assert told["run"][0]["target"]["embedder"] == "embed_hashed"


def test_answers_are_retried_and_failures_named(spark):
    from passagemill.functions.models import answered

    def make():
        tries, made = {}, [0]
        made[0] += 1

        def ask(prompt):
            tries[prompt] = tries.get(prompt, 0) + 1
            if prompt == "never" or (prompt.startswith("late") and tries[prompt] < 3):
                raise ValueError(f"try {tries[prompt]}")
            return f"{prompt}!{made[0]}"

        return ask

    rows = [(1, "a"), (2, "never"), (3, None), (4, "late1"), (5, "late2")]
    asked = spark.createDataFrame(rows, "id long, prompt string").coalesce(1)
    got = {r.id: (r.reply, r.failure) for r in answered(asked, make, retries=2, wait_s=0.0).collect()}
    assert got == {1: ("a!1", None), 2: (None, "ValueError: try 3"), 3: (None, "no prompt"), 4: ("late1!1", None), 5: ("late2!1", None)}
    broken = answered(asked, lambda: 1 / 0, retries=0, wait_s=0.0).collect()
    assert {r.failure for r in broken} == {"ZeroDivisionError: division by zero", "no prompt"}


def test_calls_in_flight_are_bounded(spark):
    from passagemill.functions.models import answered

    def make():
        import threading
        import time

        now, lock, most = [0], threading.Lock(), [0]

        def ask(prompt):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.01)
            with lock:
                now[0] -= 1
            return str(most[0])

        return ask

    replies = answered(spark.range(60, numPartitions=1).selectExpr("cast(id as string) prompt"), make, in_flight=4).collect()
    assert 2 <= max(int(r.reply) for r in replies) <= 4 and [r.prompt for r in replies] == [str(k) for k in range(60)]


@pytest.mark.parametrize("arrow", [7, 1000])
def test_encoder_calls_are_filled_across_arrow_batches(spark, arrow):
    from passagemill.functions.models import encoded

    def make():
        calls = [0]

        def encode(texts):
            calls[0] += 1
            lengths = [len(t) for t in texts]
            assert lengths == sorted(lengths)
            return [[float(t[1:] or 0), float(len(texts)), float(calls[0])] for t in texts]

        return encode

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, arrow)
    try:
        rows = spark.range(95, numPartitions=1).selectExpr("id", "concat('x', cast((id * 7919) % 1009 as string)) text")
        got = encoded(rows.unionByName(spark.createDataFrame([(95, None)], rows.schema)).coalesce(1), make, batch=10, window=3).collect()
    finally:
        spark.conf.set(key, own)
    assert [r.id for r in got] == list(range(96))
    assert all(r.embedding[0] == (r.id * 7919 % 1009 if r.id < 95 else 0) for r in got)
    assert sorted({r.embedding[2]: r.embedding[1] for r in got}.values()) == [6.0] + [10.0] * 9


def test_texts_are_read_twice_at_most(spark, tmp_path):
    from passagemill import jobs

    rows = [(f"/c/{k:02d}.md", f"text number {k % 5} " * 30) for k in range(20)]
    spark.createDataFrame(rows, "path string, text string").write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    chunks = jobs.text_chunks(jobs.hashed(files), "/c")  # the first reading is done by now
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    texts = [line for line in plan.splitlines() if "Relation [" in line and "text#" in line.split("Relation [")[1]]
    assert len(texts) == 1
    assert {r.path for r in chunks.select("path").collect()} == {f"/c/{k:02d}.md" for k in range(5)}


def test_recall_inputs_in_two_tables_move_no_texts(spark):
    from passagemill.operators import evaluation as ev
    from passagemill.options import RetrievalOptions

    docs = spark.createDataFrame([(k, f"{k} " * 150, "s") for k in range(8)], "pk long, text string, source string")
    held = spark.createDataFrame([(k, [float(k == i) for i in range(8)]) for k in range(0, 8, 2)], "chunk_id long, embedding array<float>")
    lengths = docs.selectExpr("pk", "length(text) AS length").join(held.selectExpr("chunk_id AS pk"), "pk")
    sample = ev.eval_sample(docs, lengths=lengths)
    assert sorted(r.pk for r in sample.collect()) == [0, 2, 4, 6]
    fields = docs.selectExpr("pk AS chunk_id", "source AS name", "source AS original_filename", "array(source) AS headers", "text")
    queries, options = held.withColumnRenamed("chunk_id", "qid"), RetrievalOptions(top_k=2)
    apart = jobs.contexts(queries, held, options, sources=fields)
    joined = jobs.contexts(queries, held.join(fields, "chunk_id"), options)
    assert sorted(apart.collect()) == sorted(joined.collect()) and apart.count() == 4
