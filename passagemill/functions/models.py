"""Plugging in outside models: one per worker, called in full batches or with a few calls in flight."""

from __future__ import annotations

import sys
import time
import types
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Chat = Callable[[str], str]
Encoder = Callable[[list[str]], list[list[float]]]


def worker_model(key: str, make: Callable[[], object]):
    """The model that this worker process made for ``key``; later tasks of the worker find it again.

    Functions travel with their own globals, so the models are kept by a module that
    outlives them.
    """
    held = sys.modules.setdefault("_models_of_this_worker", types.ModuleType("_models_of_this_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def _asked(key: str, make: Callable[[], Chat], prompt: str | None, retries: int, wait_s: float) -> tuple[str | None, str | None]:
    """The reply, or why there is none."""
    if prompt is None:
        return None, "no prompt"
    failure = ""
    for attempt in range(retries + 1):
        if attempt:
            time.sleep(wait_s * 2 ** (attempt - 1))
        try:
            return str(worker_model(key, make)(prompt)), None
        except Exception as e:  # any failure of an outside model is the same to us
            failure = f"{type(e).__name__}: {e}"
    return None, failure


def replier(make: Callable[[], Chat], retries: int = 0) -> Callable[[Column], Column]:
    """Arrow function ``prompt -> reply`` from a factory of a model call.

    The factory runs once per worker, and only when there is a prompt; a call that fails
    gives null, so later steps fall back instead of losing the row.
    """
    key = uuid.uuid4().hex

    @F.pandas_udf(T.StringType())
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series([_asked(key, make, p, retries, 0.0)[0] for p in prompts], dtype="object")

    return run.asNondeterministic()


def answered(
    rows: DataFrame,
    make: Callable[[], Chat],
    prompt: str = "prompt",
    in_flight: int = 8,
    retries: int = 2,
    wait_s: float = 0.5,
) -> DataFrame:
    """``rows`` with ``reply``, and ``failure`` where there is none after ``retries`` more tries.

    A task has at most ``in_flight`` calls open; the model must allow that many at once.  As a
    model may answer differently each time, callers write the result before they read it twice.
    """
    key, names = uuid.uuid4().hex, rows.columns
    at = names.index(prompt)
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("failure", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as calls:
            for batch in batches:
                told = list(calls.map(lambda p: _asked(key, make, p, retries, wait_s), batch.column(at).to_pylist()))
                reply, failure = (pa.array([x[k] for x in told], pa.string()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, reply, failure], [*names, "reply", "failure"])

    return rows.mapInArrow(run, schema)


def encoded(
    rows: DataFrame,
    make: Callable[[], Encoder],
    text: str = "text",
    output: str = "embedding",
    batch: int = 256,
    window: int = 16,
) -> DataFrame:
    """``rows`` with the vector that an encoder gives for each text; a null text counts as empty.

    The encoder is made once per worker and called with ``batch`` texts at a time, filled up
    across Arrow batches: only a task's last call may be smaller.  ``window`` calls' texts are
    taken together and sorted by length, so that texts of one call need little padding; rows
    come out in the order they came.
    """
    key, names = uuid.uuid4().hex, rows.columns
    at = names.index(text)
    schema = T.StructType([*rows.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])

    def done(held: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in held.column(at).to_pylist()]
        order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        vectors: list = [None] * len(texts)
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            for place, vector in zip(some, worker_model(key, make)([texts[p] for p in some]), strict=True):
                vectors[place] = vector
        full = held.append_column(output, pa.array(vectors, pa.list_(pa.float32())))
        yield from full.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for some in batches:
            held = pa.Table.from_batches([some]) if held is None else pa.concat_tables([held, pa.Table.from_batches([some])])
            while held.num_rows >= batch * window:
                yield from done(held.slice(0, batch * window).combine_chunks())
                held = held.slice(batch * window)
        if held is not None and held.num_rows:
            yield from done(held.combine_chunks())

    return rows.mapInArrow(run, schema)
