"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every window of five bytes gives six triplets (the first byte with each pair of the four
after it), hashed into 256 buckets.  A bucket's count is written as two bits: the quarter
of all 256 counts that it falls into.  Ahead of them stand a byte for the logarithm of the
length and one for the ratios of the quartiles.  Two digests differ by a bounded score:
0, 1, 2 or 6 for each bucket, and small sums for length and ratios; likeness is one minus
the score over its maximum.

``neighbours`` pairs each row with the next one in descending ``doc_id`` without a global
sort of texts in one task: rows are dealt into slices of ids by approximate quantiles, and
the first row of each slice is copied to the end of the slice before it.  A slice is sorted
and streamed; ties of ids are ordered by their text.

Edge cases: a null text counts as empty; a text of fewer than five bytes has all-zero
counts, told apart by length only and by a checksum of its bytes; null ids come last;
repeated rows follow each other; a single row is its own neighbour; empty tables stay empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm import common


@dataclass(frozen=True)
class FingerprintOptions:
    rows_per_slice: int = 4_096
    most_slices: int = 16_384


_TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_KEYS = [(common.mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * k + 1)) >> np.uint64(20)).astype(np.uint8) for k in range(3)]
_SALTS = (np.arange(6) * 41 + 11).astype(np.uint8)
_BODY = np.array([0, 1, 2, 6])
_MOST = 256 * 6 + 48 + 2 * 6 + 4


def digests(rows: list[bytes]) -> np.ndarray:
    """One row of 260 small numbers for each text: checksum, length, two ratios, 256 quarters."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    data = np.frombuffer(b"".join(rows), np.uint8)
    parts = [_digest_step(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in common.steps(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, 260), np.uint8)


def _digest_step(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    windows = np.maximum(size - 4, 0)
    m = max(len(data) - 4, 0)
    inside = np.repeat(np.tile([True, False], n), np.stack([windows, size - windows], axis=1).ravel())[:m]
    base = np.repeat(np.arange(n) * 256, size)[:m][inside]
    a, b, c = (key[data] for key in _KEYS)
    counts = np.zeros(n * 256, np.int64)
    for salt, (i, j) in zip(_SALTS, _TRIPLETS):
        bucket = (a[:m] ^ b[i : i + m] ^ c[j : j + m] ^ salt)[inside]
        counts += np.bincount(base + bucket, minlength=n * 256)
    counts = counts.reshape(n, 256)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = ordered[:, 63], ordered[:, 127], ordered[:, 191]
    out = np.zeros((n, 260), np.uint8)
    sums = common.prefix_sums(data)
    out[:, 0] = common.span_hashes(sums, offsets[:-1], offsets[1:]) >> np.uint64(56)
    out[:, 1] = np.minimum(np.round(12 * np.log2(size + 1.0)), 255)
    out[:, 2] = (q1 * 16 // np.maximum(q3, 1)) % 16
    out[:, 3] = (q2 * 16 // np.maximum(q3, 1)) % 16
    out[:, 4:] = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    return out


def written(digest: np.ndarray) -> list[str]:
    """Hexadecimal text of each digest: checksum, length, ratios, then four buckets a byte."""
    body = digest[:, 4:].reshape(len(digest), 64, 4)
    packed = (body << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2).astype(np.uint8)
    head = np.stack([digest[:, 0], digest[:, 1], digest[:, 2] << 4 | digest[:, 3]], axis=1)
    raw = np.concatenate([head, packed], axis=1)
    return [r.tobytes().hex() for r in raw]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 for equal digests, down to 0; the same in either order."""
    off = np.abs(x.astype(np.int16) - y)
    ring = np.minimum(off[:, 2:4], 16 - off[:, 2:4])
    score = _BODY[off[:, 4:]].sum(axis=1) + np.minimum(off[:, 1], 48) + np.minimum(ring, 6).sum(axis=1) + 4 * (off[:, 0] > 0)
    return 1 - score / _MOST


def _slice_of(key: Column, bounds: list[int]) -> Column:
    """How many of the falling bounds lie above the key, found in two short scans."""
    width = 128
    above = lambda b: b > key
    coarse = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds[::width]]), above)) if bounds else F.lit(0)
    if len(bounds) <= width:
        return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), above)) if bounds else F.lit(0)
    first = F.greatest(coarse - 1, F.lit(0)) * width
    every = F.array(*[F.lit(b).cast("long") for b in bounds])
    return first + F.size(F.filter(F.slice(every, first + 1, F.lit(width)), above))


def neighbours(docs: DataFrame, options: FingerprintOptions = FingerprintOptions()) -> DataFrame:
    """(slice, copy, doc_id, text) such that in the order (slice, copy, doc_id falling, text) each row stands before its next one.

    Rows with ``copy`` only close a slice: they are the next slice's first.
    """
    lowest = -(1 << 63)
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    total = keyed.count()
    parts = max(1, min(options.most_slices, -(-total // options.rows_per_slice)))
    cuts = [k / parts for k in range(1, parts)]
    bounds = keyed.agg(F.percentile_approx("key", cuts, 4 * options.most_slices).alias("b")).first()["b"] if cuts and total else []
    falling = sorted(set(bounds or []), reverse=True)
    sliced = keyed.withColumn("slice", _slice_of(F.col("key"), falling))
    heads = [(r["slice"], r["top"]) for r in sliced.groupBy("slice").agg(F.max("key").alias("top")).orderBy("slice").collect()]  # most_slices rows at most
    copies = [(top, heads[k - 1][0]) for k, (_, top) in enumerate(heads)]
    target = F.create_map(*[F.lit(x).cast("long") for pair in copies for x in pair]) if copies else F.create_map().cast("map<bigint,bigint>")
    where = F.array(F.struct(F.col("slice").cast("long").alias("slice"), F.lit(False).alias("copy")))
    more = F.when(F.element_at(target, F.col("key")).isNotNull(), F.array(F.struct(F.element_at(target, F.col("key")).alias("slice"), F.lit(True).alias("copy"))))
    dealt = sliced.select("doc_id", "key", "text", F.explode(F.concat(where, F.coalesce(more, F.array().cast("array<struct<slice:bigint,copy:boolean>>")))).alias("at"))
    return dealt.select("at.slice", "at.copy", "doc_id", "key", "text")


def fingerprints(docs: DataFrame, options: FingerprintOptions = FingerprintOptions()) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    common.bounded_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            held = table.slice(table.num_rows - 1)
            own = ~table["copy"].to_numpy()[:-1]
            text = table["text"].to_pylist()
            raw = [t.encode() for t in text]
            print_ = digests(raw)
            at = np.flatnonzero(own)
            edited = []
            for k in at:
                half = len(text[k]) // 2
                edited.append((text[k][: len(text[k]) - half] + text[k + 1][:half]).encode())
            changed = digests(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    table["doc_id"].combine_chunks().take(pa.array(at)),
                    pa.array([len(text[k]) for k in at], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                    pa.array(written(print_[at]), pa.string()),
                    pa.array(written(changed), pa.string()),
                    pa.array(likeness(print_[at], changed)),
                    pa.array(likeness(print_[at], print_[at + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    rows = neighbours(docs, options).repartition("slice").sortWithinPartitions("slice", "copy", F.desc("key"), "text")
    return rows.select("copy", "doc_id", "text").mapInArrow(
        run,
        f"doc_id {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
