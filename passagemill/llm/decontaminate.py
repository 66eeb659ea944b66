"""Benchmark decontamination with an FM-index per training shard.

Words are runs of digits, letters and bytes from 0x80 after lower-casing A-Z.  A shard is a
run of documents of one task with up to ``shard_words`` words; its word numbers, with a
separator after each document, are sorted by suffix, and the Burrows-Wheeler transform is
kept in a wavelet matrix of bit planes with rank counts.  All test phrases (windows of
``window`` words of the benchmark's items) are searched backwards at once; places of the
matches come from sampled suffix positions, walking back until one is met.  Overlapping
places are merged into removal spans.

The benchmark is the stated query set: its items are read in blocks of at most
``block_windows`` windows, one broadcast each, and every block searches all documents, so no
broadcast grows with the benchmark.  Documents are never shuffled.  The search of the last
block also makes the result: a second Python step in the stage would give each core a second
worker, which stays alive through the stages after it.

Edge cases: null and empty texts have no words and are clean; an item of fewer words than a
window, but not none, is one shorter window; an item without words matches nothing; repeated
items count once by id, items of equal text each by its own id; a null item_id is written as
an empty string; repeated documents get equal results; empty tables stay empty or clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import common


@dataclass(frozen=True)
class DecontaminateOptions:
    window: int = 10
    shard_words: int = 400_000
    sample: int = 16  # every so many places keep their position
    block_windows: int = 200_000


# ---------------------------------------------------------------- the index


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in their order, by doubling the compared length; only ties are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    head = np.ones(n, bool)
    head[1:] = symbols[order][1:] != symbols[order][:-1]
    rank = np.empty(n, np.int64)
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = first
    width = 1
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))  # slots of suffixes that still tie
    while len(open_) and width < n:
        at = order[open_]
        follow = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + follow
        again = np.argsort(key, kind="stable")
        key, at = key[again], at[again]
        order[open_] = at
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        rank[at] = open_[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        open_ = open_[~(head & np.append(head[1:], True))]
        width *= 2
    return order


class WaveletMatrix:
    """Bit planes of a sequence, highest first, each dealt zeros before ones for the next."""

    def __init__(self, values: np.ndarray, bits: int):
        self.size, self.bits = len(values), bits
        self.words, self.before, self.zeros = [], [], []
        values = values.astype(np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = ((values >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bool)), bitorder="little").view("<u8")
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value stands before each place."""
        start, end = np.zeros_like(at), at
        for k in range(self.bits):
            one = ((value >> (self.bits - 1 - k)) & 1).astype(bool)
            s, e = self._ones(k, start), self._ones(k, end)
            start, end = np.where(one, self.zeros[k] + s, start - s), np.where(one, self.zeros[k] + e, end - e)
        return end - start

    def get(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            one = ((self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._ones(k, at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
            value = value * 2 + one
        return value


class FMIndex:
    """Searches a sequence of symbols (1 ends every document, a single 0 the sequence) for many phrases at once."""

    def __init__(self, symbols: np.ndarray, kinds: int, sample: int):
        order = suffix_order(symbols)
        self.size = len(symbols)
        self.last = WaveletMatrix(symbols[order - 1], max(1, int(kinds).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=kinds + 1))])
        kept = order % sample == 0
        self.kept = WaveletMatrix(kept, 1)
        self.positions = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each phrase, the symbols right-aligned in its row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            live = live[(lengths[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - step]
            low[live] = self.first[symbol] + self.last.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.last.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each suffix row: back through the text to a sampled one."""
        out, walked = np.zeros(len(rows), np.int64), 0
        live = np.arange(len(rows))
        at = rows.copy()
        while len(live):
            kept = self.kept.get(at).astype(bool)
            if kept.any():
                out[live[kept]] = self.positions[self.kept.rank(np.ones(int(kept.sum()), np.int64), at[kept])] + walked
            live, at = live[~kept], at[~kept]
            symbol = self.last.get(at)
            at = self.first[symbol] + self.last.rank(symbol, at)
            walked += 1
        return out


# ---------------------------------------------------------------- phrases


@dataclass
class Phrases:
    """Distinct windows, right-aligned word hashes, and the items that have each (``items[begin[w]:begin[w + 1]]``)."""

    hashes: np.ndarray
    lengths: np.ndarray
    begin: np.ndarray
    items: np.ndarray
    names: list[str]


def phrase_blocks(benchmark: DataFrame, options: DecontaminateOptions) -> Iterator[Phrases]:
    """The benchmark's windows, read item by item and given out in bounded blocks."""
    window = options.window
    rows, lengths, of, names = [], [], [], []
    number: dict[str, int] = {}

    def block() -> Phrases:
        keys = np.array(rows, np.uint64).reshape(-1, window)
        size = np.array(lengths, np.int64)
        distinct, inverse = np.unique(np.column_stack([size.astype(np.uint64), keys]), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([inverse.ravel(), np.array(of)], axis=1), axis=0)
        begin = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        return Phrases(distinct[:, 1:], distinct[:, 0].astype(np.int64), begin, pairs[:, 1], list(names))

    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        raw = (row["text"] or "").encode()
        words, _, _ = common.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), common.ALNUM)
        name = row["item_id"] or ""
        for start in range(max(len(words) - window, 0) + 1 if len(words) else 0):
            part = words[start : start + window]
            rows.append([0] * (window - len(part)) + part.tolist())
            lengths.append(len(part))
            if name not in number:
                number[name] = len(names)
                names.append(name)
            of.append(number[name])
            if len(rows) >= options.block_windows:
                yield block()
                rows, lengths, of, names, number = [], [], [], [], {}
    if rows:
        yield block()


# ---------------------------------------------------------------- documents


def _shards(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: their word hashes, the words' byte starts and ends, and the first word of each row."""
    held, count, begun = [], 0, 0
    data, offsets = common.utf8(column)

    def merged(end: int):
        words, starts, ends, sizes = (np.concatenate([p[k] for p in held]) for k in range(4))
        held.clear()  # not beside the merged ones while the shard is searched
        return begun, end, words, starts, ends, np.concatenate([[0], np.cumsum(sizes)])

    for first, end in common.steps(offsets):
        part, local = data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        low = common.LOWER[part]
        starts, ends = common.spans(common.ALNUM[low], local)
        words = common.span_hashes(common.prefix_sums(low), starts, ends)
        row = np.searchsorted(local, starts, side="right") - 1
        sizes = np.bincount(row, minlength=end - first)
        held.append((words, starts - local[row], ends - local[row], sizes))
        count += len(words)
        if count >= limit:
            yield merged(end)
            count, begun = 0, end
    if held:
        yield merged(len(column))


def _hits(words: np.ndarray, begin: np.ndarray, phrases: Phrases, options: DecontaminateOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of the phrases in a shard: document, first word, length in words, window."""
    none = np.zeros(0, np.int64)
    kinds, numbers = np.unique(words, return_inverse=True)
    sizes = np.diff(begin)
    at = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)  # a separator stands after each document
    symbols = np.ones(len(words) + len(sizes) + 1, np.int64)
    symbols[at], symbols[-1] = numbers + 2, 0
    slot = np.searchsorted(kinds, phrases.hashes)
    known = slot < len(kinds)
    known[known] = kinds[slot[known]] == phrases.hashes[known]
    outside = np.arange(phrases.hashes.shape[1]) < (phrases.hashes.shape[1] - phrases.lengths)[:, None]
    possible = np.flatnonzero((known | outside).all(axis=1))
    index = FMIndex(symbols, len(kinds) + 1, options.sample)
    if not len(possible):
        return none, none, none, none
    low, high = index.search(slot[possible] + 2, phrases.lengths[possible])
    found = np.maximum(high - low, 0)
    window = np.repeat(possible, found)
    rows = np.repeat(low, found) + np.arange(len(window)) - np.repeat(np.cumsum(found) - found, found)
    place = index.locate(rows)
    document = np.searchsorted(begin[1:] + np.arange(1, len(sizes) + 1), place, side="right")
    return document, place - document, phrases.lengths[window], window


def _noted(rows: pa.RecordBatch, words: np.ndarray, begin: np.ndarray, block: Phrases, options: DecontaminateOptions) -> pa.RecordBatch:
    """A shard's rows with one block's findings: ``spans`` (first word and end of each occurrence) and ``items``."""
    document, start, length, window = _hits(words, begin, block, options)
    if not len(document):
        return rows
    pairs = np.unique(np.stack([document, start - begin[document], start - begin[document] + length], axis=1), axis=0)
    sizes = block.begin[window + 1] - block.begin[window]
    item = block.items[np.repeat(block.begin[window], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    named = np.unique(np.stack([np.repeat(document, sizes), item], axis=1), axis=0)
    spans, items = (rows.schema.get_field_index(c) for c in ("spans", "items"))
    old_spans, old_items = rows.column(spans).to_pylist(), rows.column(items).to_pylist()
    for d in np.unique(document):
        old_spans[d] = old_spans[d] + pairs[pairs[:, 0] == d, 1:].ravel().tolist()
        old_items[d] = sorted({*old_items[d], *(block.names[i] for i in named[named[:, 0] == d, 1])})
    columns = rows.columns
    columns[spans] = pa.array(old_spans, rows.schema.field(spans).type)
    columns[items] = pa.array(old_items, rows.schema.field(items).type)
    return pa.RecordBatch.from_arrays(columns, schema=rows.schema)


#: Makes result rows of a shard's rows, the byte starts and ends of their words and the first word of each row.
Finish = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]


def _searched(rows: DataFrame, text: Callable[[pa.RecordBatch], pa.Array], benchmark: DataFrame, options: DecontaminateOptions, finish: Finish, schema: str) -> DataFrame:
    """What ``finish`` makes of all rows with the findings of all blocks; ``text`` gives a batch's texts."""
    common.bounded_batches(rows.sparkSession)

    def search(found: DataFrame, phrases: Phrases | None, last: bool) -> DataFrame:
        shared = common.shipped(found.sparkSession, phrases)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared()
            for batch in batches:
                for first, end, words, starts, ends, begin in _shards(text(batch), options.shard_words):
                    part = batch.slice(first, end - first)
                    if block is not None and len(words):
                        part = _noted(part, words, begin, block, options)
                    yield finish(part, starts, ends, begin) if last else part
                pa.default_memory_pool().release_unused()

        return found.mapInArrow(run, schema if last else found.schema)

    found = rows.withColumn("spans", F.array().cast("array<bigint>")).withColumn("items", F.array().cast("array<string>"))
    blocks = phrase_blocks(benchmark, options)
    block = next(blocks, None)  # None: no item has words
    while (following := next(blocks, None)) is not None:
        found, block = common.staged(search(found, block, False)), following
    return search(found, block, True)


def _covered(spans: list[int], words: int) -> np.ndarray:
    """Which words of a document lie in a span."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, spans[0::2], 1)
    np.add.at(edge, spans[1::2], -1)
    return np.cumsum(edge)[:-1] > 0


def report(docs: DataFrame, benchmark: DataFrame, options: DecontaminateOptions = DecontaminateOptions()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""

    def told(part: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        words, items = np.diff(begin), part.column(3).to_pylist()
        hit = np.array([_covered(s, n).sum() if s else 0 for s, n in zip(part.column(2).to_pylist(), words)], np.int64)
        columns = [
            part.column(0), pa.array(words.astype(np.int64)), pa.array(hit), pa.array([len(i) for i in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items], pa.string()), pa.array(hit > 0),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return _searched(docs.select("doc_id", "text"), lambda batch: batch.column(1), benchmark, options, told, schema)


def cleaned(docs: DataFrame, benchmark: DataFrame, options: DecontaminateOptions = DecontaminateOptions()) -> DataFrame:
    """The rows, with all their columns, without the benchmark's words.

    A removal span runs from its first word to the end of its last; one space takes its
    place.  Texts without a hit stay as they are; a document that loses its last word is
    left out.  ``n_chars``, where there is one, follows the text.
    """
    columns = docs.columns
    place = columns.index("text")
    text = lambda batch: batch.column(0).field(place)

    def cut(part: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        """The rows that stay; text and size are null where nothing was cut."""
        data, offsets = common.utf8(text(part))
        spans = part.column(1).to_pylist()
        keep, out = np.ones(len(spans), bool), [None] * len(spans)
        for d in [d for d, s in enumerate(spans) if s]:
            a, b = begin[d], begin[d + 1]
            inside = np.concatenate([[False], _covered(spans[d], b - a), [False]])
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            raw, pieces, last = data[offsets[d] : offsets[d + 1]].tobytes(), [], 0
            for low, high in zip(edges[0::2], edges[1::2]):
                pieces.append(raw[last : starts[a + low]])
                last = int(ends[a + high - 1])
            pieces.append(raw[last:])
            out[d] = b" ".join(p.strip() for p in pieces).strip().decode()
            keep[d] = (~inside[1:-1]).any()
        sizes = [None if t is None else len(t) for t in out]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array(sizes, pa.int64())], ["row", "text", "size"]).filter(pa.array(keep))

    rows = docs.select(F.struct(*columns).alias("row"))
    done = _searched(rows, text, benchmark, options, cut, f"row {rows.schema['row'].dataType.simpleString()}, text string, size long")
    value = {"text": F.col("text"), "n_chars": F.col("size")}
    return done.select(*[F.coalesce(value[c].cast(docs.schema[c].dataType), F.col("row")[c]).alias(c) if c in value else F.col("row")[c].alias(c) for c in columns])
