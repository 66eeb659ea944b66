"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` counts, in vectorised steps over the bytes of whole texts, what the trees
split on: sizes, shares of letters, capitals, digits, marks and symbols, word and line
lengths, and how often words and lines repeat.  ``fit`` grows trees of one depth level by
level from per-bin sums of gradients; ``Forest`` keeps all trees in flat arrays, so a
batch of documents walks down all of them at once.

Training reads a sample of at most ``per_label`` rows of either label (``labelled_sample``),
whose statistics, a few numbers a row, go to the driver.  Scoring is map-only.

Edge cases: null and empty texts have zero statistics and get a score like any other;
without labelled rows every score is 0.5; with one label only, the score is near that
label; repeated rows get equal scores; an empty table gives an empty table.
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
class QualityOptions:
    per_label: int = 6_000  # bound of the training sample, rows of each label
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.2
    least_weight: float = 4.0  # hessian weight that a side of a split needs
    ridge: float = 1.0
    accept: float = 0.3  # documents that score less are rejected
    modulus: int = 5  # rows with crc32 remainder 0 are held out


# kinds of bytes
_KINDS = 10
_KIND = np.full(256, 6, np.uint8)  # 6: other marks
_KIND[0x61:0x7B] = 0
_KIND[0x41:0x5B] = 1
_KIND[0x30:0x3A] = 2
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_KIND[0x0A] = 4
_KIND[[0x2E, 0x2C, 0x3B, 0x3A, 0x3F, 0x27, 0x22]] = 5
_KIND[[0x7C, 0x5C, 0x2F, 0x3C, 0x3E, 0x7B, 0x7D, 0x5B, 0x5D]] = 7
_KIND[0x21] = 8
_KIND[0x80:] = 9

STATISTICS = 24


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _repeats(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and how often its commonest occurs."""
    keys, at, counts = np.unique(common.mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, rows[at], counts)
    return np.bincount(rows[at], minlength=n), most


def _step(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    sums = common.prefix_sums(data)
    starts, ends = common.spans(common.NON_SPACE[data], offsets)
    of = np.searchsorted(offsets, starts, side="right") - 1
    words, lengths = np.bincount(of, minlength=n).astype(float), (ends - starts).astype(float)
    letters = np.concatenate([[0], np.cumsum((_KIND[data] <= 1) | (_KIND[data] == 9))])
    capitals = np.concatenate([[0], np.cumsum(_KIND[data] == 1)])
    alphabetic, big = letters[ends] - letters[starts], capitals[ends] - capitals[starts]
    distinct, most = _repeats(common.span_hashes(sums, starts, ends), of, n)
    line_starts, line_ends = common.spans(data != 0x0A, offsets)
    line_of = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = np.bincount(line_of, minlength=n).astype(float)
    distinct_lines, _ = _repeats(common.span_hashes(sums, line_starts, line_ends), line_of, n)
    longest = np.zeros(n)
    np.maximum.at(longest, of, lengths)
    mean = _ratio(np.bincount(of, lengths, minlength=n), words)
    spread = np.sqrt(np.maximum(_ratio(np.bincount(of, lengths**2, minlength=n), words) - mean**2, 0))
    count = lambda mask: np.bincount(of[mask], minlength=n)
    columns = [
        np.log1p(size), np.log1p(words), mean, spread, np.log1p(longest),
        *(_ratio(kinds[:, k], size) for k in range(_KINDS)),
        _ratio(distinct, words), _ratio(most, words), _ratio(distinct_lines, lines), np.log1p(lines), _ratio(words, lines),
        _ratio(count(alphabetic == 0), words), _ratio(count((alphabetic > 0) & (alphabetic < ends - starts)), words),
        _ratio(count((big == alphabetic) & (alphabetic > 1)), words), _ratio(count((big > 0) & (big < alphabetic)), words),
    ]
    return np.stack(columns, axis=1)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` numbers for each text, from all of its bytes."""
    found = [_step(data, offsets) for _, _, data, offsets in common.texts(column)]
    return np.concatenate(found) if found else np.zeros((0, STATISTICS))


@dataclass
class Forest:
    """All trees in flat arrays: node ``k`` of tree ``t`` is at ``t * (2**depth - 1) + k``."""

    start: float
    depth: int
    feature: np.ndarray
    border: np.ndarray  # go right where the statistic is greater
    value: np.ndarray  # of the 2**depth leaves of each tree

    def score(self, x: np.ndarray) -> np.ndarray:
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        trees = len(self.value) // leaves
        out = np.full(len(x), self.start)
        if trees:
            base = np.arange(trees) * inner
            for first in range(0, len(x), 2048):
                part = x[first : first + 2048]
                rows = np.arange(len(part))[:, None]
                node = np.zeros((len(part), trees), np.int64)
                for _ in range(self.depth):
                    at = base + node
                    node = 2 * node + 1 + (part[rows, self.feature[at]] > self.border[at])
                out[first : first + 2048] += self.value[np.arange(trees) * leaves + node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, options: QualityOptions) -> Forest:
    """Trees grown on the gradients of the logistic loss, splits found in per-bin sums."""
    if not len(y):
        return Forest(0.0, options.depth, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    weight = weight / weight.mean()
    share = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    n, f, b = len(y), x.shape[1], options.bins
    borders = np.quantile(x, np.linspace(0, 1, b + 1)[1:-1], axis=0)  # (b - 1, f)
    binned = np.stack([np.searchsorted(borders[:, k], x[:, k], side="left") for k in range(f)], axis=1)
    cells = np.arange(f) * b + binned
    inner, leaves = (1 << options.depth) - 1, 1 << options.depth
    features, cuts, values = [], [], []
    total = np.full(n, start)
    for _ in range(options.trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = (y - p) * weight, p * (1 - p) * weight
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)  # within the level
        for level in range(options.depth):
            wide = 1 << level
            at = (node[:, None] * (f * b) + cells).ravel()
            g = np.bincount(at, np.repeat(gradient, f), wide * f * b).reshape(wide, f, b).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hessian, f), wide * f * b).reshape(wide, f, b).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + options.ridge) + (all_g - g) ** 2 / (all_h - h + options.ridge) - all_g**2 / (all_h + options.ridge)
            gain[(h < options.least_weight) | (all_h - h < options.least_weight)] = 0
            gain = gain[:, :, :-1].reshape(wide, -1)
            best = gain.argmax(axis=1)
            split = gain[np.arange(wide), best] > 1e-9
            k, bin_ = best // (b - 1), best % (b - 1)
            place = wide - 1 + np.arange(wide)
            feature[place] = k
            cut[place] = np.where(split, borders[bin_, k], np.inf)
            node = 2 * node + (split[node] & (binned[np.arange(n), k[node]] > bin_[node]))
        leaf = options.rate * np.bincount(node, gradient, leaves) / (np.bincount(node, hessian, leaves) + options.ridge)
        total = total + leaf[node]
        features.append(feature), cuts.append(cut), values.append(leaf)
    flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Forest(start, options.depth, flat(features, np.int64), flat(cuts, float), flat(values, float))


def train(docs: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions()) -> Forest:
    """A forest from the bounded sample of labelled documents (``labels.quality`` 1 is good)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "weight", "x"])

    common.bounded_batches(docs.sparkSession)
    sample = common.labelled_sample(docs, labels, "quality", options.modulus, options.per_label)
    key = sample.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", "text", "y", "weight").mapInArrow(read, f"doc_id {key}, y boolean, weight double, x array<double>").orderBy("doc_id").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, STATISTICS)
    return fit(x, got["y"].to_numpy().astype(float), got["weight"].to_numpy(), options)


def scores(docs: DataFrame, forest: Forest, options: QualityOptions = QualityOptions()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = common.shipped(docs.sparkSession, forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            score = model.score(statistics(batch.column(2)))
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= options.accept).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(common.crc_remainder(F.col("doc_id"), options.modulus) == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, forest: Forest, options: QualityOptions = QualityOptions()) -> DataFrame:
    """The rows, with all their columns, whose score is at least ``options.accept``."""
    shared = common.shipped(docs.sparkSession, forest)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            yield batch.filter(pa.array(model.score(statistics(batch.column(place))) >= options.accept))

    return docs.mapInArrow(run, docs.schema)
