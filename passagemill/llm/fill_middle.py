"""Fill-in-the-middle: every batch of texts cut and reordered by one displacement scatter.

A text is cut into tokens (white space and the word behind it; white space at the end is a
token by itself) and, by a hash of its id, at two of their borders into prefix, middle and
suffix.  Half of the texts stay plain; the others come out as

    psm  ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
    spm  ``<S>`` suffix ``<P>`` prefix ``<M>`` middle

The texts of a step lie in one byte array.  Each piece moves as a whole, so the change of
displacement at its first byte goes into a difference array; the cumulative sum gives every
byte its output shift and one scatter writes all outputs, markers in the gaps.  ``restore``
reads outputs and forms alone: it finds the markers, derives the same shifts the other way
round, and gathers the texts back.

Edge cases: a null text is empty; empty texts and texts that hold a marker stay plain; a
null id hashes as an empty one; rows that repeat an id are cut by the same hashes; an empty
table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import common


@dataclass(frozen=True)
class MiddleOptions:
    seed: int = 42
    rate: int = 50  # of 100 texts, so many are transformed
    suffix_first: int = 80  # of 100 transformed texts, so many are spm


PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
MARKS = np.frombuffer(b"<P><S><M>", np.uint8).reshape(3, 3)
# The order of the pieces (0 prefix, 1 middle, 2 suffix) in the output; a piece follows its marker.
_ORDER = np.array([[0, 1, 2], [0, 2, 1], [2, 0, 1]])
_MARK_OF = np.array([0, 2, 1])


def choices(ids: list, seed: int) -> np.ndarray:
    """The first four 32-bit numbers of each id's digest."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(len(ids), 4).astype(np.int64)


def token_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends of the tokens of all rows, and the first token of each row."""
    _, ends = common.spans(common.NON_SPACE[data], offsets)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    loose = filled[common.SPACES[data[offsets[filled + 1] - 1]]]  # white space at the end of the row
    ends = np.sort(np.concatenate([ends, offsets[loose + 1]]))
    return ends, np.searchsorted(ends, offsets, side="right")


def _marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(marker, place) of all markers that lie within one row."""
    at = np.flatnonzero(data == MARKS[0, 0])
    at = at[at + 2 < len(data)]
    at = at[data[at + 2] == MARKS[0, 2]]
    at = at[np.isin(data[at + 1], MARKS[:, 1])]
    at = at[np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + 2, side="right")]
    return np.stack([np.argmax(data[at + 1][:, None] == MARKS[:, 1], axis=1), at])


def _index(n: int) -> type:
    return np.int32 if n < 1 << 31 else np.int64


def _shifts(starts: np.ndarray, sizes: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """How far each of ``n`` bytes moves, pieces of given starts and sizes covering them all."""
    kind = _index(n + len(starts) * 3)
    there = sizes > 0
    order = np.argsort(starts[there], kind="stable")
    first, move = starts[there][order], (to - starts)[there][order]
    steps = np.zeros(n, kind)
    steps[first] = np.diff(move, prepend=0)
    return np.cumsum(steps, dtype=kind)


@dataclass
class Cut:
    form: np.ndarray
    borders: np.ndarray  # of each row: start, first cut, second cut, end, in bytes
    tokens: np.ndarray


def cut(data: np.ndarray, offsets: np.ndarray, ids: list, options: MiddleOptions = MiddleOptions()) -> Cut:
    ends, first = token_ends(data, offsets)
    tokens = np.diff(first)
    h = choices(ids, options.seed)
    units = np.sort(h[:, :2] % (tokens + 1)[:, None], axis=1)
    begin = offsets[:-1]
    borders = np.stack([begin, begin, begin, offsets[1:]], axis=1)
    for k in (0, 1):
        some = units[:, k] > 0
        borders[some, k + 1] = ends[first[:-1][some] + units[some, k] - 1]
    held = np.zeros(len(tokens), bool)
    held[np.searchsorted(offsets, _marked(data, offsets)[1], side="right") - 1] = True
    form = np.where(h[:, 3] % 100 < options.suffix_first, SPM, PSM)
    form[held | (np.diff(offsets) == 0) | (h[:, 2] % 100 >= options.rate)] = PLAIN
    return Cut(form, borders, tokens)


def scatter(data: np.ndarray, offsets: np.ndarray, made: Cut) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of all rows in one array, and the row offsets into it."""
    size = np.diff(made.borders, axis=1)
    moved = made.form != PLAIN
    out = np.concatenate([[0], np.cumsum(np.diff(offsets) + 9 * moved)]).astype(np.int64)
    target = np.zeros_like(size)
    spot = out[:-1].copy()
    marks = []
    for k in range(3):
        piece = _ORDER[made.form, k]
        marks.append((spot[moved].copy(), _MARK_OF[piece[moved]]))
        spot += 3 * moved
        rows = np.arange(len(piece))
        target[rows, piece] = spot
        spot += size[rows, piece]
    result = np.zeros(out[-1], np.uint8)
    shift = _shifts(made.borders[:, :3].ravel(), size.ravel(), target.ravel(), len(data))
    result[np.arange(len(data), dtype=shift.dtype) + shift] = data
    for at, mark in marks:
        for j in range(3):
            result[at + j] = MARKS[mark, j]
    return result, out


def restore(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that outputs of the given forms were made of, gathered from their bytes."""
    moved = np.flatnonzero(form != PLAIN)
    size = np.diff(offsets)
    mark, at = _marked(data, offsets)
    row = np.searchsorted(offsets, at, side="right") - 1
    mine = form[row] != PLAIN
    at, row, mark = at[mine].reshape(-1, 3), row[mine].reshape(-1, 3), mark[mine].reshape(-1, 3)
    if len(at) != len(moved) or (row != moved[:, None]).any() or (mark != _MARK_OF[_ORDER[form[moved]]]).any():
        raise ValueError("outputs whose markers do not fit their forms")
    # pieces in the order of the output: a plain row is one piece, any other three
    starts, ends = at + 3, np.concatenate([at[:, 1:], offsets[moved + 1][:, None]], axis=1)
    lengths = ends - starts
    back = np.concatenate([[0], np.cumsum(size - 9 * (form != PLAIN))]).astype(np.int64)
    by_piece = np.zeros_like(lengths)
    np.put_along_axis(by_piece, _ORDER[form[moved]], lengths, axis=1)
    place = back[moved][:, None] + np.cumsum(by_piece, axis=1) - by_piece
    target = np.take_along_axis(place, _ORDER[form[moved]], axis=1)
    plain = np.flatnonzero(form == PLAIN)
    starts = np.concatenate([offsets[plain], starts.ravel()])
    lengths = np.concatenate([size[plain], lengths.ravel()])
    target = np.concatenate([back[plain], target.ravel()])
    shift = _shifts(target, lengths, starts, int(back[-1]))
    return data[np.arange(back[-1], dtype=shift.dtype) + shift], back


def _code_points(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte."""
    total = np.zeros(len(data) + 1, _index(len(data) + 1))
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total


def transform(docs: DataFrame, options: MiddleOptions = MiddleOptions()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; the counts are null for plain texts."""
    common.bounded_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offsets in common.texts(batch.column(1)):
                own = ids.slice(first, end - first)
                made = cut(data, offsets, own.to_pylist(), options)
                output, at = scatter(data, offsets, made)
                chars = np.diff(_code_points(data)[made.borders], axis=1)
                plain = made.form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [
                        own,
                        pa.array(made.tokens),
                        pa.array(FORMS[made.form].tolist(), pa.string()),
                        pa.array(chars[:, 0].astype(np.int64), mask=plain),
                        pa.array(chars[:, 1].astype(np.int64), mask=plain),
                        common.strings(output, at),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame) -> DataFrame:
    """The rows of ``transform`` with ``text``, rebuilt from ``output`` and ``form``."""
    common.bounded_batches(made.sparkSession)
    schema = made.schema
    names = [f for f in schema.names if f != "text"]
    kinds = ", ".join(f"`{n}` {schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = np.searchsorted(FORMS, batch.column(names.index("form")).to_pylist()) if batch.num_rows else np.zeros(0, np.int64)
            for first, end, data, offsets in common.texts(batch.column(names.index("output"))):
                text, at = restore(data, offsets, forms[first:end])
                rows = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*rows.columns, common.strings(text, at)], [*names, "text"])

    return made.select(*names).mapInArrow(run, f"{kinds}, text string")


def digests(docs: DataFrame, options: MiddleOptions = MiddleOptions()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    back = restored(transform(docs, options))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))
