"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is read as lower-cased letters with single spaces between words; its features are
the hashed n-grams of ``orders`` bytes that occur in it.  From a bounded sample of labelled
rows, tasks count in how many toxic and other documents each n-gram occurs; the log ratio
of the two smoothed shares scales the feature, and a logistic model with a ridge penalty is
fitted on the scaled features (the ``features`` n-grams that differ most between the
labels).  Scoring hashes every n-gram of the whole text and keeps the ones the model knows.

Edge cases: null and empty texts have no features and get the model's base score; without
labelled rows every score is 0; with one label only, nothing distinguishes documents and
every score is that label's share; repeated rows get equal scores; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import common


@dataclass(frozen=True)
class ToxicityOptions:
    per_label: int = 4_000  # bound of the training sample, rows of each label
    orders: tuple[int, ...] = (3, 4, 5, 6, 7, 8)  # of 8 bytes at most
    buckets_log2: int = 20
    features: int = 8_192
    smooth: float = 1.0
    ridge: float = 0.02
    rounds: int = 300
    accept: float = 0.5
    modulus: int = 5


def grams(data: np.ndarray, offsets: np.ndarray, options: ToxicityOptions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket at every start of an n-gram, and the mask of starts that stay in their row."""
    stream, ends = common.letters(data, offsets)
    last = np.concatenate([ends[1:]])
    for n in options.orders:
        m = max(len(stream) - n + 1, 0)
        key = np.zeros(m, np.uint64)
        for k in range(n):
            key |= stream[k : k + m].astype(np.uint64) << np.uint64(8 * k)
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        inside = np.ones(m, bool)
        for k in range(1, n):
            cut = last - k
            inside[cut[(cut >= 0) & (cut < m)]] = False
        yield (key >> np.uint64(64 - options.buckets_log2)).astype(np.int64), inside, ends


def present(data: np.ndarray, offsets: np.ndarray, of: np.ndarray, options: ToxicityOptions) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs; ``of`` gives a bucket's feature, or -1."""
    found, width = [], int(of.max(initial=-1)) + 1
    for bucket, inside, ends in grams(data, offsets, options):
        feature = of[bucket]
        at = np.flatnonzero((feature >= 0) & inside)
        row = np.searchsorted(ends, at, side="right") - 1
        found.append(np.unique(row * width + feature[at]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return (pairs // width, pairs % width) if width else (pairs, pairs)


@dataclass
class Model:
    bias: float
    of: np.ndarray  # bucket -> feature or -1
    weight: np.ndarray  # coefficient times log-count ratio
    options: ToxicityOptions

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for first, end, data, offsets in common.texts(column):
            total = np.zeros(end - first)
            if len(self.weight):
                row, feature = present(data, offsets, self.of, self.options)
                total = np.bincount(row, self.weight[feature], end - first)
            out.append(1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def solve(row: np.ndarray, value: np.ndarray, feature: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, options: ToxicityOptions) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on sparse rows by accelerated gradient steps."""
    w, b = np.zeros(width), 0.0
    norm = np.bincount(row, value**2, len(y))
    rate = 1.0 / (0.25 * np.average(norm + 1, weights=weight) * 4 + options.ridge)
    momentum, moved, moved_b = 0.0, np.zeros(width), 0.0
    share = weight / weight.sum()
    for k in range(options.rounds):
        v, vb = w + momentum * moved, b + momentum * moved_b
        z = np.bincount(row, value * v[feature], len(y)) + vb
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        new = v - rate * (np.bincount(feature, value * off[row], width) + options.ridge * v / len(y))
        new_b = vb - rate * off.sum()
        moved, moved_b, w, b = new - w, new_b - b, new, new_b
        momentum = k / (k + 3.0)
    return w, b


def train(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> Model:
    """A model of ``labels.toxic`` from the bounded sample of labelled documents."""
    common.bounded_batches(docs.sparkSession)
    buckets = 1 << options.buckets_log2
    sample = common.staged(common.labelled_sample(docs, labels, "toxic", options.modulus, options.per_label).select("doc_id", "text", "y", "weight"))
    every = np.arange(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, buckets), np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            for first, end, data, offsets in common.texts(batch.column(0)):
                row, bucket = present(data, offsets, every, options)
                for label in (0, 1):
                    seen[label] += np.bincount(bucket[y[first:end][row] == label], minlength=buckets)
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1, at]), pa.array(seen[0, at])], ["bucket", "n1", "n0"])

    sizes = {r["y"]: (r["n"], r["w"]) for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    empty = Model(-30.0, np.full(1, -1), np.zeros(0), options)
    if len(sizes) < 2:
        return Model(30.0, empty.of, empty.weight, options) if True in sizes else empty
    counted = sample.select("text", "y").mapInArrow(count, "bucket long, n1 long, n0 long").groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    share = lambda n, y: (F.col(n) + options.smooth) / (sizes[y][0] + 2 * options.smooth)
    p, q = share("n1", True), share("n0", False)
    differ = (p - q) * (p - q) / ((p + q) * (2 - p - q))
    top = counted.select("bucket", F.log(p / q).alias("ratio"), differ.alias("differ")).orderBy(F.desc("differ"), "bucket").limit(options.features).toArrow()
    of = np.full(buckets, -1)
    of[top["bucket"].to_numpy()] = np.arange(len(top))
    ratio = top["ratio"].to_numpy()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in common.texts(batch.column(1)):
                row, feature = present(data, offsets, of, options)
                cut = np.searchsorted(row, np.arange(end - first + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature, pa.int32()))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), lists], ["doc_id", "y", "weight", "x"])

    key = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(read, f"doc_id {key}, y boolean, weight double, x array<int>").orderBy("doc_id").toArrow()
    x = got["x"].combine_chunks()
    lengths = np.diff(x.offsets.to_numpy())
    row, feature = np.repeat(np.arange(len(got)), lengths), x.flatten().to_numpy()
    w, bias = solve(row, ratio[feature], feature, got["y"].to_numpy().astype(float), got["weight"].to_numpy(), len(ratio), options)
    return Model(float(bias), of.astype(np.int32), w * ratio, options)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared, options = common.shipped(docs.sparkSession, model), model.options

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            score = own.score(batch.column(2))
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= options.accept).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(common.crc_remainder(F.col("doc_id"), options.modulus) == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
