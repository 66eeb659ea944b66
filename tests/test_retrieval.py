import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.functions.embed import embed_hashed, embedder, unit
from passagemill.functions.prompts import NO_RESULTS, parse_order
from passagemill.operators import context as ctx
from passagemill.operators import retrieval as rt
from passagemill.operators import cells, parts, vectors
from passagemill.options import RetrievalOptions


def options(**changes):
    return RetrievalOptions(**{"top_k": 3, "fetch_k": 10, **changes})


@pytest.fixture(scope="module")
def fixture(spark):
    """Twenty passages whose dense order for the query is their id."""
    data = [(i, [1.0, i / 10.0]) for i in range(20)]
    collection = spark.createDataFrame(data, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0], "q")], "qid long, embedding array<float>, query string")
    return queries, collection


def ids(ranked):
    return [r.chunk_id for r in ranked.orderBy("qid", "rank").collect()]


def test_defaults():
    o = RetrievalOptions()
    assert (o.top_k, o.fetch_k, o.mmr_lambda, o.backend, o.candidate_k) == (10, 40, 0.5, "none", 40)
    assert options(rerank_backend="cohere").backend == "none"
    assert options(rerank_backend=" MMR ").backend == "mmr"
    assert options(rerank_backend=None).backend == "none"
    assert options(top_k=8, fetch_k=2).candidate_k == 8


def test_dense_is_single_pass(fixture):
    assert ids(rt.retrieve(*fixture, options())) == [0, 1, 2]
    assert ids(rt.retrieve(*fixture, options(rerank_backend="cohere"))) == [0, 1, 2]


def test_pool_is_never_smaller_than_top_k(fixture):
    assert ids(rt.candidate_pool(*fixture, options())) == list(range(10))
    assert ids(rt.candidate_pool(*fixture, options(top_k=8, fetch_k=2))) == list(range(8))


@pytest.mark.parametrize(
    "reply, want",
    [("passages ranked: 5, 2, 9", [4, 1, 8]), ("only one good: 4", [3, 0, 1]), (None, [0, 1, 2]), ("99999999999999999999", [0, 1, 2])],
)
def test_listwise(spark, fixture, reply, want):
    replies = spark.createDataFrame([(1, reply)], "qid long, reply string")
    assert ids(rt.retrieve(*fixture, options(rerank_backend="llm"), replies)) == want


def test_listwise_without_a_reply_row_or_with_a_small_pool(spark, fixture):
    queries, collection = fixture
    none = spark.createDataFrame([], "qid long, reply string")
    assert ids(rt.retrieve(queries, collection, options(rerank_backend="llm"), none)) == [0, 1, 2]
    two = collection.where("chunk_id < 2")
    replies = spark.createDataFrame([(1, "2, 1")], "qid long, reply string")
    assert ids(rt.retrieve(queries, two, options(rerank_backend="llm"), replies)) == [0, 1]
    pool = rt.candidate_pool(queries, two, options()).withColumn("text", F.lit("x"))
    assert rt.rerank_prompts(pool, queries, options()).count() == 0


def test_rerank_prompt_lists_the_pool(spark, fixture):
    pool = rt.candidate_pool(*fixture, options()).withColumn("text", F.concat(F.lit("passage \n "), F.col("chunk_id").cast("string")))
    prompt = rt.rerank_prompts(pool, fixture[0], options()).first().prompt
    assert "Question: q\n\nPassages:\n[1] passage 0\n[2] passage 1\n" in prompt
    assert "[10] passage 9\n\nReturn" in prompt and "List only the 3 most\n" in prompt


@pytest.mark.parametrize(
    "reply, n, want",
    [("3, 3, 1, 0, 12, 4", 5, [2, 0, 3, 1, 4]), ("no idea, sorry", 4, [0, 1, 2, 3]), ("1 2", 0, []), ("007, 99999999999999999999", 7, [6, 0, 1, 2, 3, 4, 5])],
)
def test_parse_order(spark, reply, n, want):
    df = spark.createDataFrame([(reply, n)], "reply string, n int")
    assert df.select(parse_order(F.col("reply"), F.col("n")).alias("o")).first().o == want


def test_mmr_skips_near_copies(spark):
    v = [[1.0, 0.0, 0.0], [0.999, 0.01, 0.0], [0.7, 0.7, 0.0], [0.7, 0.0, 0.7]]
    collection = spark.createDataFrame(list(enumerate(v)), "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "qid long, embedding array<float>")
    picked = ids(rt.retrieve(queries, collection, options(top_k=2, rerank_backend="mmr", mmr_lambda=0.3)))
    assert ids(rt.retrieve(queries, collection, options(top_k=2))) == [0, 1]
    assert picked[0] == 0 and picked[1] in (2, 3)
    assert ids(rt.retrieve(queries, collection, options(top_k=3, rerank_backend="mmr", mmr_lambda=1.0))) == [0, 1, 2]


@pytest.mark.parametrize("limit", [1024, 3])
def test_exact_topk_against_brute_force(spark, limit):
    rng = np.random.default_rng(3)
    held = rng.integers(-3, 4, (200, 8)).astype(float)  # small whole numbers: many ties
    asked = rng.integers(-3, 4, (9, 8)).astype(float)
    collection = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid long, embedding array<double>")
    got = {}
    for r in vectors.exact_topk(queries, collection.repartition(7), 12, limit, skip_same_id=True).collect():
        got.setdefault(r.qid, {})[r.rank] = r.chunk_id
    sizes = np.outer(np.linalg.norm(asked, axis=1), np.linalg.norm(held, axis=1))
    scores = np.divide(asked @ held.T, sizes, out=np.zeros((9, 200)), where=sizes > 0)
    for q in range(9):
        order = [i for i in np.lexsort((np.arange(200), -np.round(scores[q], 12))) if i != q][:12]
        assert [got[q][k] for k in range(1, 13)] == order
    profile = {r.qid: r for r in vectors.score_profile(queries, collection, limit).collect()}
    assert profile[4].n_vectors == 200 and abs(profile[4].mean_score - scores[4].mean()) < 1e-12


def test_search_plan_neither_crosses_nor_shuffles_the_collection(fixture):
    plan = rt.dense_topk(*fixture, options())._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan


@pytest.mark.parametrize("shape", ["spread", "clustered"])
def test_index_finds_neighbours_in_the_cells_it_probes(spark, tmp_path, shape):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(3000, 16))
    if shape == "clustered":
        base = 4 * rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] + base
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(5000, None), (5001, [1.0]), (5002, [float("nan")] * 16)]
    collection = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = collection.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "qid")
    cells.build(collection, f"{tmp_path}/index")
    stored = spark.read.parquet(f"{tmp_path}/index/rows")
    assert sorted(r.chunk_id for r in stored.select("chunk_id").collect()) == list(range(3000))
    found = cells.search(spark, queries, f"{tmp_path}/index", 10)
    recall = vectors.recall_at_k(found.top, vectors.exact_topk(queries, collection, 10))
    assert recall.agg(F.avg("recall")).first()[0] >= 0.9
    effort = found.effort.agg(F.sum("coded"), F.sum("scored"), F.count("*")).first()
    assert effort[2] == 60 and effort[1] <= 0.2 * 3000 * 60
    if shape == "clustered":
        assert effort[0] <= 0.2 * 3000 * 60
    everywhere = cells.search(spark, queries, f"{tmp_path}/index", 10, probes=10_000)
    exact = {(r.qid, r.rank): r.chunk_id for r in vectors.exact_topk(queries, collection, 10).collect()}
    same = [exact[r.qid, r.rank] == r.chunk_id for r in everywhere.top.collect()]
    assert len(same) == len(exact) == 600 and np.mean(same) > 0.99


def test_index_of_an_empty_collection(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    cells.build(none, f"{tmp_path}/index")
    assert cells.search(spark, none.withColumnRenamed("chunk_id", "qid"), f"{tmp_path}/index", 3).top.count() == 0


def test_many_queries_read_the_collection_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    collection = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)))], "chunk_id long, embedding array<double>")
    collection = collection.unionByName(spark.createDataFrame([(900, [1.0, 0.0]), (901, [0.0, 2.0])], collection.schema))
    collection.write.parquet(f"{tmp_path}/collection")
    collection.withColumnRenamed("chunk_id", "qid").write.parquet(f"{tmp_path}/queries")
    collection, queries = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("collection", "queries"))
    want = {(r.qid, r.rank): r.chunk_id for r in vectors.exact_topk(queries, collection, 3).collect()}
    many = vectors.exact_topk(queries, collection, 3, max_broadcast_queries=10)
    assert {(r.qid, r.rank): r.chunk_id for r in many.collect()} == want
    assert many._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2  # forty blocks of ten, one scan


def test_lists_of_the_best_merge_in_steps(spark):
    rows = [(q, p, 1000 * q + p, float((p * 7919) % 1000)) for q in range(3) for p in range(1000)]
    lists = spark.createDataFrame(rows, "qid long, part long, chunk_id long, score double")
    got = {(r.qid, r.rank): r.score for r in parts.merged(lists, 4, 1000).collect()}
    assert got == {(q, k): 1000.0 - k for q in range(3) for k in range(1, 5)}


def test_empty_collection_gives_the_fixed_context(spark, fixture):
    queries, collection = fixture
    ranked = rt.dense_topk(queries, collection.where("chunk_id < 0"), options()).select(
        "qid", "rank", F.lit("n").alias("name"), F.lit(None).cast("string").alias("original_filename"),
        F.array().cast("array<string>").alias("headers"), F.lit("t").alias("text"),
    )
    assert ctx.build_context(queries, ranked).first().context == NO_RESULTS


def test_sources_and_prompts(spark):
    rows = [(1, 2, "", "o.pdf", ["A", None, "", "B"], "two"), (1, 1, "n.md", "o", None, "one"), (1, 3, None, "", [], "three")]
    ranked = spark.createDataFrame(
        rows, "qid long, rank int, name string, original_filename string, headers array<string>, text string"
    )
    context = ctx.build_context(spark.createDataFrame([(1,)], "qid long"), ranked).first().context
    assert context == "[1] n.md\none\n\n[2] o.pdf › A › B\ntwo\n\n[3] unknown\nthree"
    turns = spark.createDataFrame(
        [("c", 1, "q1", "x1"), ("c", 2, "q2", "x2"), ("c", 3, "q3", "x3")],
        "conversation_id string, turn_id long, question string, context string",
    )
    history = spark.createDataFrame([("c", 1, "q1", "a1")], "conversation_id string, turn_id long, question string, answer string")
    got = [(r.turn_id, r.type, r.content) for r in ctx.turn_prompts(turns, history).orderBy("turn_id", "part").collect()]
    assert got[:2] == [(1, "human", "q1"), (1, "ai", "a1")]
    assert len(got) == 3 and got[2][2].endswith("Sources:\nx3\n\nQuestion: q3")


def test_embedders(spark):
    df = spark.createDataFrame([("a b A",), ("",), (None,)], "text string")
    counts = [r.embedding for r in embed_hashed(df.where("text is not null")).collect()]
    assert sum(counts[0]) == 3 and max(counts[0]) == 2 and sum(counts[1]) == 0
    size = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(unit(F.col("v")).alias("u")).collect()
    assert [r.u for r in size] == [[0.6, 0.8], [0.0, 0.0]]
    model = embedder(lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert [r.e for r in df.select(model(F.col("text")).alias("e")).collect()] == [[5.0, 1.0], [0.0, 1.0], [0.0, 1.0]]


def vectors_of(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, embedding array<double>")


def test_missing_and_misshapen_vectors_take_no_part(spark):
    collection = vectors_of(spark, [(0, [1.0, 0.0]), (1, None), (2, [0.0, 1.0]), (3, [1.0]), (4, [None, 1.0]), (5, [])], "chunk_id")
    queries = vectors_of(spark, [(7, [1.0, 0.1]), (8, None), (9, [2.0])], "qid")
    got = {(r.qid, r.rank): r.chunk_id for r in vectors.exact_topk(queries, collection, 5).collect()}
    assert got == {(7, 1): 0, (7, 2): 2, (9, 1): 3}
    assert tuple(vectors.vector_faults(collection, 2).first()) == (6, 2, 2)
    assert vectors.exact_topk(queries.where("qid < 0"), collection, 5).count() == 0
    assert vectors.score_profile(queries.where("qid < 0"), collection).count() == 0


def test_mmr_keeps_dense_order_where_a_vector_is_missing(spark):
    rows = [(1, r, 10 + r, 1.0 - r / 10, None if r == 2 else [1.0, r / 10]) for r in range(1, 5)]
    pool = spark.createDataFrame(rows, "qid long, rank int, chunk_id long, score double, embedding array<double>")
    got = rt.mmr(pool, options(top_k=3, rerank_backend="mmr")).orderBy("rank").collect()
    assert [(r.rank, r.chunk_id, r.dense_rank) for r in got] == [(1, 11, 1), (2, 12, 2), (3, 13, 3)]


@pytest.mark.parametrize("reply, want", [("３，１", [2, 0, 1]), ("٢ then १", [1, 0, 2])])
def test_parse_order_reads_digits_of_other_scripts(spark, reply, want):
    df = spark.createDataFrame([(reply, 3)], "reply string, n int")
    assert df.select(parse_order(F.col("reply"), F.col("n")).alias("o")).first().o == want


@pytest.mark.parametrize("dim", [64, 200, 256, 1000])
def test_embedding_counts_every_word_in_any_dimension(spark, dim):
    from passagemill.functions.embed import word_bucket_counts

    text = " ".join(f"w{i}" for i in range(2000))
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(word_bucket_counts(F.col("t"), dim).alias("v")).collect()
    assert [len(r.v) for r in got] == [dim] * 3 and [sum(r.v) for r in got] == [2000, 0, 0]


def test_a_part_is_shared_by_tasks(spark, monkeypatch):
    from passagemill.operators import parts, vectors

    rows = spark.range(60).selectExpr("id AS chunk_id", "array(cast(id % 7 AS float), cast(id % 5 AS float), 1f) AS embedding")
    queries = rows.withColumnRenamed("chunk_id", "qid")
    want = sorted(vectors.exact_topk(queries, rows, 3, 1000, skip_same_id=True).collect())
    assert parts.query_groups(2_000, 1) == 1 and parts.query_groups(600_000, 10) == 10
    monkeypatch.setattr(parts, "GROUP_ROWS", 10)
    assert parts.query_groups(60, 1) == 6
    assert sorted(vectors.exact_topk(queries, rows, 3, 0, skip_same_id=True).collect()) == want and len(want) == 180


def test_a_bucket_gets_a_query_once_and_gives_its_best(spark, tmp_path, monkeypatch):
    size = np.array([3, 0, 20, 4, 4, 9])
    monkeypatch.setattr(cells, "BUCKET_ROWS", 8)
    monkeypatch.setattr(parts, "TASKS", 100)
    first, subs, count = cells.buckets(size, 4)
    assert (first.tolist(), subs.tolist(), count) == ([0, 0, 2, 0, 0, 5], [1, 1, 3, 1, 1, 2], 7)
    made = np.random.default_rng(3).normal(size=(700, 8)).astype(np.float32)
    collection = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "chunk_id long, embedding array<float>")
    cells.build(collection, f"{tmp_path}/index")
    queries = collection.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "qid")
    want = {(r.qid, r.chunk_id) for r in vectors.exact_topk(queries, collection, 5).collect()}
    met, meet = [], parts.meet

    def watched(held, asked, work, schema, *count):
        found = meet(held, asked, work, schema, *count)
        met.append((held.count(), asked.count(), found.count()))
        return found

    monkeypatch.setattr(parts, "meet", watched)
    for rows, group in ((4_096, 16_384), (16, 10), (8, 16_384)):
        monkeypatch.setattr(cells, "BUCKET_ROWS", rows)
        monkeypatch.setattr(cells, "GROUP_ROWS", group)
        found = cells.search(spark, queries, f"{tmp_path}/index", 5, probes=10_000)
        assert {(r.qid, r.chunk_id) for r in found.top.collect()} == want
        assert {tuple(r) for r in found.effort.select("coded", "scored").collect()} == {(700, 40)}
    assert met[0] == (700, 35, 35 * 40)  # 43 cells before
    assert met[1][0] == 700 * 4  # groups of queries


def test_scores_are_made_in_bounded_steps(monkeypatch):
    units = np.random.default_rng(5).normal(size=(500, 4))
    want = (units @ units[:100].T).argmax(axis=1)
    monkeypatch.setattr(cells, "STEP_VALUES", 1_000)
    assert (cells._nearest(units, units[:100]) == want).all()
    import pyarrow as pa

    ids = pa.array(range(500))
    held = pa.RecordBatch.from_arrays([ids, pa.array(units.tolist())], ["id", "embedding"])
    monkeypatch.setattr(vectors, "STEP_VALUES", 5_000)
    assert [len(q) for q, _, _, _ in vectors._pairs(held, held.slice(0, 25))] == [10, 10, 5]
