from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from passagemill.operators import conversations as cv
from passagemill.operators import evaluation as ev
from passagemill.schemas import CHAT_EVENT
from passagemill.streaming import events as live

TEXT, THINK = "response.output_text.delta", "response.reasoning.delta"


def meta(t_in=0, t_out=0, title=None):
    return ("c", 0.0, title, t_in, t_out)


def stream(turn, closing):
    rows = [
        ("response", "response.function_call_arguments.delta", "Calling", meta()),
        ("function", "retrieve", "ctx", meta()),
        ("response", THINK, "hm", meta()),
        ("response", TEXT, "Hel", meta()),
        ("response", THINK, "m", meta()),
        ("response", TEXT, "lo", meta()),
        closing,
    ]
    return [("c", turn, seq, *row) for seq, row in enumerate(rows)]


DONE = ("complete", "completion", "", meta(7, 2, "T"))
CUT = ("cancel", "chat.cancel", "", meta(3, 1))


def test_fold_events(spark):
    events = spark.createDataFrame(stream(1, DONE) + stream(2, CUT)[::-1] + stream(3, DONE)[:4], CHAT_EVENT)
    got = {r.turn_id: r for r in cv.fold_events(events).collect()}
    assert (got[1].context, got[1].reasoning, got[1].answer, got[1].status) == ("ctx", "hmm", "Hello", "complete")
    assert (got[1].metadata.title, got[1].metadata.input_tokens_used) == ("T", 7)
    assert (got[2].answer, got[2].status, got[2].metadata.output_tokens_used) == ("Hello", "cancel", 1)
    assert (got[3].answer, got[3].status, got[3].metadata) == ("Hel", None, None)


def test_live_fold_waits_for_late_events(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    early = stream(1, DONE)[::2] + stream(2, CUT)  # turn 1 lacks three events at first
    spark.createDataFrame(early, CHAT_EVENT).coalesce(1).write.mode("append").json(source)

    def run():
        live.run_to_table(live.fold_event_stream(live.read_events(spark, source)), target, progress)
        return {r.turn_id: (r.context, r.reasoning, r.answer, r.status, r.input_tokens_used) for r in spark.read.parquet(target).collect()}

    assert run() == {2: ("ctx", "hmm", "Hello", "cancel", 3)}
    def left(name):
        return spark.read.format("statestore").option("stateVarName", name).load(progress).count()

    assert left("open") == 1 and left("parts") == 4  # one turn is open
    again = stream(1, DONE)[1::2] + stream(1, DONE)[:3] + [("c", 1, 9, "response", TEXT, "!", meta())]
    spark.createDataFrame(again, CHAT_EVENT).coalesce(1).write.mode("append").json(source)
    assert run()[1] == ("ctx", "hmm", "Hello", "complete", 7)
    assert left("open") == 0 and left("parts") == 0


TURNS = "conversation_id string, turn_id long, question string, answer string, status string"


def test_history_and_titles(spark):
    turns = spark.createDataFrame(
        [
            ("a", 1, "cancelled", "x", "cancel"),
            ("a", 2, "  \n ", "blank", "complete"),
            ("a", 3, " New Chat ", "literal", "complete"),
            ("a", 4, "  " + "q" * 80, "real", "complete"),
            ("a", 5, "later", "later", "complete"),
            ("b", 1, "only cancelled", "", "cancel"),
        ],
        TURNS,
    )
    history = cv.completed_history(turns).orderBy("turn_id", "part").collect()
    assert [(r.turn_id, r.kind) for r in history] == [(t, k) for t in (2, 3, 4, 5) for k in ("human", "ai")]
    titles = cv.session_titles(turns)
    assert {r.conversation_id: r.title for r in titles.collect()} == {"a": "q" * 60, "b": "New Chat"}
    sessions = spark.createDataFrame(
        [
            ("a", datetime(2026, 1, 1, tzinfo=timezone.utc)),
            ("b", datetime(2026, 1, 2, 3, 4, 5, 60, tzinfo=timezone.utc)),
            ("z", datetime(2025, 1, 1, tzinfo=timezone.utc)),
        ],
        "conversation_id string, created_at timestamp",
    )
    assert [tuple(r) for r in cv.list_sessions(sessions, titles).collect()] == [
        ("b", "New Chat", "2026-01-02T03:04:05.000060+00:00"),
        ("a", "q" * 60, "2026-01-01T00:00:00+00:00"),
        ("z", "New Chat", "2025-01-01T00:00:00+00:00"),
    ]
    asked = spark.createDataFrame([("a",), ("nobody",)], "conversation_id string")
    assert {r.conversation_id for r in cv.clear_sessions(turns, asked).collect()} == {"b"}
    assert {r.conversation_id: r.existed for r in cv.clear_report(sessions, asked).collect()} == {"a": True, "nobody": False}


def test_presented_history(spark):
    rows = [("a", 1, 0, "human", "q"), ("a", 1, 1, "ai", "r"), ("a", 2, 0, "tool", "t")]
    messages = spark.createDataFrame(rows, "conversation_id string, turn_id long, part int, kind string, content string")
    assert {(r.role, r.type) for r in cv.present_history(messages).collect()} == {("user", "human"), ("assistant", "ai"), ("unknown", "unknown")}
    assert cv.present_history(messages, for_display=True).count() == 2


def test_token_usage_adds_up(spark):
    usage = spark.createDataFrame([("a", 1, 5, 1), ("a", 1, 0, 4), ("a", 2, None, None)], "conversation_id string, turn_id long, input_tokens int, output_tokens int")
    assert {r.turn_id: (r.input_tokens_used, r.output_tokens_used) for r in cv.token_usage(usage).collect()} == {1: (5, 5), 2: (0, 0)}


# The published probe scores: retrieval 7/8 and 6/8, generation 6/8 and 4/8, one hard failure.
PROBES = [("R1", 4, 5), ("R2", 5, 3), ("R3", 4, 0), ("D1", 2, 2), ("D2", 5, 3), ("G1", 5, 5), ("G2", 4, 4), ("N1", 3, 4)]


def test_published_scorecard(spark):
    probes = spark.createDataFrame(PROBES, "id string, retrieval int, generation int")
    assert tuple(ev.qa_scorecard(probes).first()) == (8, 7, 6, 6, 4, 1)
    measured = [("retrieval_strong_rate", 6 / 8), ("generation_strong_rate", 4 / 8), ("empty_answers", 1.0), ("truncated_answers", 0.0)]
    metrics = spark.createDataFrame(measured, "metric string, value double")
    got = {r.metric: r.accepted for r in ev.qa_acceptance(metrics).collect()}
    assert got == {
        "retrieval_strong_rate": False, "generation_strong_rate": False, "empty_answers": False,
        "truncated_answers": True, "unsourced_answers": False, "docx_probe_rate": False,
    }


def test_recall(spark):
    long = "x" * 50 + "y" * 100 + "z" * 100
    items = spark.createDataFrame(
        [(1, long, "s", "q"), (2, long, None, "q"), (3, "short text", "s", "q"), (4, long, "s", None)],
        "qid long, text string, source string, question string",
    )
    contexts = spark.createDataFrame([(1, "a " + "y" * 100), (2, "nothing"), (4, long)], "qid long, context string")
    hits = ev.recall_hits(items, contexts)
    assert {r.qid: (r.source, r.hit) for r in hits.collect()} == {1: ("s", True), 2: ("unknown", False), 3: ("s", False)}
    assert tuple(ev.recall_rate(hits).first()) == (1, 3, pytest.approx(100 / 3))
    assert tuple(ev.recall_rate(hits.where("false")).first()) == (0, 0, 0.0)
    picked = spark.createDataFrame([(1, 10), (2, 20)], "qid long, pk long")
    ranked = spark.createDataFrame([(1, 10), (2, 21)], "qid long, chunk_id long")
    assert {r.qid: r.chunk_hit for r in ev.exact_hits(picked, ranked).collect()} == {1: True, 2: False}


def test_eval_sample_is_seeded_and_bounded(spark):
    docs = spark.range(300).select(
        F.col("id").alias("pk"), F.repeat(F.lit("x"), F.when(F.col("id") % 2 == 0, 201).otherwise(200)).alias("text"), F.lit("s").alias("source")
    )
    one, again, other = (sorted(r.pk for r in ev.eval_sample(docs, seed=s).collect()) for s in (1, 1, 2))
    assert one == again != other
    assert len(one) == 10 and all(pk < 100 and pk % 2 == 0 for pk in one)


def test_answer_checks(spark):
    rows = [
        ("a", 1, " \n", 9000, 3),
        ("a", 2, "cut in the mid", 8192, 3),
        ("a", 3, "cut but under the cap", 10, 3),
        ("a", 4, "Fine [1][3].\nBeyond the sources: x.", 8192, 3),
        ("a", 5, "Wrong [0] and [99999999999999].", 1, 3),
    ]
    answers = spark.createDataFrame(rows, "conversation_id string, turn_id long, answer string, output_tokens_used int, n_sources int")
    got = {r.turn_id: (r.empty, r.truncated, r.beyond_sources, r.bad_citation) for r in ev.answer_checks(answers).collect()}
    assert got == {
        1: (True, False, False, False), 2: (False, True, False, False), 3: (False, False, False, False),
        4: (False, False, True, False), 5: (False, False, False, True),
    }


class Kept:
    """Value, list and timer state of one turn."""

    def __init__(self):
        self.value, self.rows, self.timers = None, [], set()

    def getValueState(self, name, schema):
        return self

    def getListState(self, name, schema):
        kept = self

        class Rows:
            get = staticmethod(lambda: iter(kept.rows))
            appendList = staticmethod(lambda rows: kept.rows.extend(rows))
            clear = staticmethod(kept.rows.clear)

        return Rows

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_turn_ignores_repeated_and_late_events():
    from pyspark.sql import Row

    kept, now = Kept(), [0]
    fold = live.TurnFold(500)
    fold.init(kept)

    class Clock:
        getCurrentProcessingTimeInMs = staticmethod(lambda: now[0])

    def feed(*rows):
        now[0] += 100
        names = ("seq", "type", "content", "status", "tokens_in", "tokens_out")
        return [tuple(r) for r in fold.handleInputRows(("c", 1), iter([Row(**dict(zip(names, r))) for r in rows]), Clock)]

    first, second = (0, TEXT, "Hel", "running", 0, 0), (1, TEXT, "lo", "running", 0, 0)
    assert feed(first, first) == [] and kept.timers == {600} and len(kept.rows) == 1
    assert feed((2, "", "", "complete", 5, 6), (3, TEXT, "late", "running", 0, 0)) == []
    assert kept.timers == {700} and kept.value[:3] == (1, [2, 3], 2)
    assert feed(second, first) == [("c", 1, "", "", "Hello", "complete", 5, 6)]
    assert kept.value is None and not kept.rows and not kept.timers
    assert feed(second) == [] and kept.value is not None  # after the turn was given out
    assert list(fold.handleExpiredTimer(("c", 1), None, None)) == [] and kept.value is None and not kept.rows
    assert feed((1, "", "", "cancel", 1, 1), (0, TEXT, "x", "running", 0, 0)) == [("c", 1, "", "", "x", "cancel", 1, 1)]


def test_events_are_packed_before_the_stateful_step(spark):
    import pyarrow as pa

    keys = [("a", 1), (None, 1), ("a", 2), ("a", None)]
    rows = [(*keys[i % 4], i // 4, TEXT, f"{i} ", "running" if i < 396 else "complete", 0, i) for i in range(400)]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.int32()] * 2]
    names = ["conversation_id", "turn_id", *live.Event._fields]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    got = [tuple(r.values()) for out in live.packed(iter([batch, batch.slice(0, 0)])) for r in out.to_pylist()]
    assert {r[:2] for r in got} == set(keys) and len(got) == 4
    for r in got:
        assert [(*r[:2], *e) for e in map(live.Event, *r[2:])] == [e for e in rows if e[:2] == r[:2]]
    events = spark.createDataFrame([("c", 1, i, "running", TEXT, "x", None) for i in range(50)], CHAT_EVENT).coalesce(1)
    flat = events.selectExpr("conversation_id", "turn_id", "seq", "type", "content", "status", "0 as tokens_in", "0 as tokens_out")
    assert flat.mapInArrow(live.packed, live.PACKED).count() == 1


def test_times_are_utc_in_any_session_zone(spark):
    from passagemill.operators.conversations import iso_utc

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/New_York", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.range(1).selectExpr("timestamp_micros(0) a", "timestamp_micros(1710055800500000) b", "timestamp_micros(-1) c")
            got = df.select(*[iso_utc(F.col(c)).alias(c) for c in "abc"]).first()
            assert tuple(got) == ("1970-01-01T00:00:00+00:00", "2024-03-10T07:30:00.500000+00:00", "1969-12-31T23:59:59.999999+00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
