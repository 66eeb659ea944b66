"""Removal of repeated passages by automata of the phrases that recur.

A word goes if it lies in a run of ``window`` words that also starts earlier in the corpus.
Every such run holds ``window - phrase + 1`` phrases of ``phrase`` words; the one with the
least hash stands for it, so equal runs are stood for by equal phrases.

1. Documents are dealt into blocks of a few megabytes, written once, compressed.  A block
   sends the hashes of its phrases that stand for a run, each once, to the slot of the hash.
   A slot answers with one bit a phrase: whether it recurs.
2. A block compiles the words of its recurring phrases into Aho-Corasick automata, shards of
   ``shard_phrases`` each, and streams its documents through them.  Runs whose standing
   phrase was located are candidates, the others occur once.  The block sends each
   different candidate with its first document to the slot of the run's hash, which
   answers with one bit: whether another block has it earlier.
3. The block removes the words of all candidates but first ones.

Texts are shuffled compressed, by block; slots see hashes only (64 bits for phrases, which
only propose; 96 for runs).  A phrase or run, however frequent, is one entry of a block, and
slots and blocks are of bounded size whatever the corpus; a document longer than a block is
a block by itself.

Edge cases: earlier means a smaller id, null ids last, rows of one id in the order of a hash
of their text, equal rows as they stand; null texts have no words; texts of fewer words than
``window`` stay whole; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import common


@dataclass(frozen=True)
class RepeatOptions:
    window: int = 20  # words
    phrase: int = 8
    block_bytes: int = 4 << 20
    piece_bytes: int = 256 << 10  # of a block's texts in one row of the shuffle
    shard_phrases: int = 32_768  # of one automaton
    slot_bytes: int = 16 << 20  # of all texts, for each slot


_OTHER = np.uint64(0xA0761D6478BD642F)  # tells the second hash of a run from the first
_LAST = (1 << 63) - 1  # the place of null ids
TEXTS, PHRASES, RECURRING, CANDIDATES, RUNS, EARLIER = range(6)  # kinds of rows


# ---------------------------------------------------------------- words of a block


@dataclass
class Words:
    """The words of the rows of a block: where they lie, their hashes, and the row of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first word of each row, and the number of words
    row: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        data, offsets = common.utf8(column)
        start, end = common.spans(common.NON_SPACE[data], offsets)
        hashes = [np.zeros(0, np.uint64)]
        step = 1 << 16
        for k in range(0, len(start), step):
            a, b = start[k : k + step], end[k : k + step]
            sums = common.prefix_sums(data[a[0] : b[-1]])
            hashes.append(common.span_hashes(sums, a - a[0], b - a[0]))
        first = np.searchsorted(start, offsets)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        return cls(data, start, end, np.concatenate(hashes), first, row)

    def runs(self, width: int) -> np.ndarray:
        """First words of all runs of ``width`` words that lie in one row."""
        at = np.arange(len(self.row))
        return at[self.first[1:][self.row] - at >= width]

    def hashes(self, starts: np.ndarray, width: int, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
        sums = common.value_sums(common.mix(self.hash ^ salt) if salt else self.hash)
        return common.span_hashes(sums, starts, starts + width)


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    done, out = 1, values
    while done < width:
        more = min(done, width - done)
        out = pick(out[: len(out) - more], out[more:])
        done += more
    return out


@dataclass
class Phrases:
    """Phrase hashes of a block, and which phrases stand for a run."""

    hash: np.ndarray  # of the phrase that starts at each word; the last words of a row have none that counts
    runs: np.ndarray  # first words of all runs
    least: np.ndarray  # of each run, the hash of the phrase that stands for it
    standing: np.ndarray  # places of standing phrases

    @classmethod
    def of(cls, words: Words, options: RepeatOptions) -> Phrases:
        n, span = len(words.row), options.window - options.phrase + 1
        hashes = np.zeros(n, np.uint64)
        starts = np.arange(max(n - options.phrase + 1, 0))
        hashes[starts] = words.hashes(starts, options.phrase)
        runs = words.runs(options.window)
        if not len(runs):
            return cls(hashes, runs, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        least = sliding(hashes, span, np.minimum)[runs]
        # a phrase stands for a run if the greatest least hash around it is its own
        around = np.zeros(n + 2 * span, np.uint64)
        around[runs + span] = least
        held = sliding(around, span, np.maximum)[1 : n + 1]
        some = np.zeros(n + 2 * span, bool)
        some[runs + span] = True
        held_any = sliding(some, span, np.logical_or)[1 : n + 1]
        return cls(hashes, runs, least, np.flatnonzero(held_any & (held == hashes)))


def slot_borders(keys: np.ndarray, slots: int) -> np.ndarray:
    """Where the slots begin and end in sorted 64-bit keys."""
    slot = (keys >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
    return np.searchsorted(slot, np.arange(slots + 1, dtype=np.uint64))


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


# ---------------------------------------------------------------- automata


def located(words: Words, phrases: Phrases, chosen: np.ndarray, options: RepeatOptions) -> np.ndarray:
    """Hashes of the phrases at places where one of the ``chosen`` phrases (given by a place of each) occurs.

    Other places hold the greatest number.  The rows are streamed as words with one space
    around each, which no phrase can match across.
    """
    import ahocorasick

    out = np.full(len(words.row), np.iinfo(np.uint64).max)
    if not len(chosen):
        return out
    length = words.end - words.start
    at = np.cumsum(length + 1) - length + 2 * words.row  # a space ahead of each word, and two more bytes at the end of a row
    plain = np.full(int(at[-1] + length[-1]) + 2, 0x20, np.uint8)
    inside = np.repeat(at - words.start, length)
    source = np.flatnonzero(common.NON_SPACE[words.data])
    plain[source + inside] = words.data[source]
    borders = at[words.first[1:-1][np.diff(words.first)[1:] > 0]] - 2 if len(words.first) > 2 else np.zeros(0, np.int64)
    plain[borders[borders >= 0]] = 0x0A
    stream = plain.tobytes().decode("latin-1")  # one letter a byte
    ends = at + length
    for k in range(0, len(chosen), options.shard_phrases):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in chosen[k : k + options.shard_phrases].tolist():
            automaton.add_word(stream[at[p] - 1 : ends[p + options.phrase - 1] + 1])
        automaton.make_automaton()
        hits = np.fromiter((e for e, _ in automaton.iter(stream)), np.int64)
        place = np.searchsorted(ends, hits) - options.phrase + 1
        out[place] = phrases.hash[place]
    return out


# ---------------------------------------------------------------- rounds


_SCHEMA = "kind int, block long, part long, data binary, extra binary"


def _row(kind: int, block: int, part: int, data: bytes, extra: bytes = b"") -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((kind, block, part, data, extra), kinds)], ["kind", "block", "part", "data", "extra"])


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    raw = sink.getvalue()
    return raw.size.to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes) -> pa.Table:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")
    return pa.ipc.open_stream(raw).read_all()


def _in_order(rows: pa.Table) -> pa.Table:
    """The rows of a block by id (null last) and a hash of the text, which comes as a third column."""
    tie = [int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "big") for t in rows["text"].to_pylist()]
    rows = rows.append_column("tie", pa.array(tie, pa.uint64()))
    place = pc.sort_indices(rows.append_column("key", rows["doc_id"].cast(pa.int64())).append_column("at", pa.array(np.arange(len(tie)))), sort_keys=[("key", "ascending"), ("tie", "ascending"), ("at", "ascending")], null_placement="at_end")
    return rows.take(place).combine_chunks()


def _blocks(docs: DataFrame, slots: int, options: RepeatOptions) -> DataFrame:
    """Rows of kind TEXTS (pieces of a block) and PHRASES (a block's standing phrases in a slot)."""

    def block(number: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = _in_order(rows)
        column = rows["text"].combine_chunks()
        for part, (a, b) in enumerate(common.steps(common.utf8(column)[1], options.piece_bytes)):
            yield _row(TEXTS, number, part, _packed(rows.slice(a, b - a).to_batches()[0]))
        phrases = Phrases.of(Words.of(column), options)
        keys, count = np.unique(phrases.hash[phrases.standing], return_counts=True)
        borders = slot_borders(keys, slots)
        for slot in np.flatnonzero(np.diff(borders)).tolist():
            a, b = borders[slot], borders[slot + 1]
            yield _row(PHRASES, number, slot, keys[a:b].tobytes(), _bits(count[a:b] > 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for a, b in common.steps(common.utf8(batch.column(1))[1], options.piece_bytes):
                rows = pa.Table.from_batches([batch.slice(a, b - a)])
                held.append(rows)
                size += common.utf8(rows["text"])[1][-1]
                if size >= options.block_bytes:
                    yield from block(number, pa.concat_tables(held).combine_chunks())
                    number, held, size = number + 1, [], 0
        if held:
            yield from block(number, pa.concat_tables(held).combine_chunks())
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def _answers(rows: DataFrame, kind: int, answer) -> DataFrame:
    """Rows of ``kind`` with one bit for each key of ``rows``, decided by ``answer`` slot by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (slot,), table in common.grouped(batches, 1):
            blocks, data, extra = (table.column(k).to_pylist() for k in (1, 2, 3))
            masks = answer(blocks, data, extra)
            n = len(blocks)
            columns = [np.full(n, kind, np.int32), np.array(blocks, np.int64), np.full(n, slot, np.int64), [_bits(m) for m in masks], [b""] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["kind", "block", "part", "data", "extra"])

    dealt = rows.select("part", "block", "data", "extra").repartition("part").sortWithinPartitions("part", "block")
    return dealt.mapInArrow(run, _SCHEMA)


def _split(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _recurs(blocks: list[int], data: list[bytes], extra: list[bytes]) -> list[np.ndarray]:
    keys = np.frombuffer(b"".join(data), np.uint64)
    sizes = [len(d) // 8 for d in data]
    many = np.concatenate([_mask(e, n) for e, n in zip(extra, sizes)])
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    return _split((count[inverse] > 1) | many, sizes)


def _owners(of: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> bytes:
    used, index = np.unique(of, return_inverse=True)
    return len(used).to_bytes(4, "little") + ids[used].tobytes() + ties[used].tobytes() + index.astype(np.uint32 if len(used) >> 16 else np.uint16).tobytes()


def _has_earlier(blocks: list[int], data: list[bytes], extra: list[bytes]) -> list[np.ndarray]:
    sizes = [len(d) // 12 for d in data]
    key = np.concatenate([np.frombuffer(d, np.uint64, n) for d, n in zip(data, sizes)])
    check = np.concatenate([np.frombuffer(d, np.uint32, n, 8 * n) for d, n in zip(data, sizes)])
    ids, ties = [], []
    for e in extra:
        n = int.from_bytes(e[:4], "little")
        index = np.frombuffer(e, np.uint32 if n >> 16 else np.uint16, offset=4 + 16 * n)
        ids.append(np.frombuffer(e, np.int64, n, 4)[index])
        ties.append(np.frombuffer(e, np.uint64, n, 4 + 8 * n)[index])
    order = np.lexsort((np.repeat(blocks, sizes), np.concatenate(ties), np.concatenate(ids), check, key))
    same = (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    return _split(out, sizes)


def _per_block(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(block, texts, data by kind)`` for each block, with its pieces joined and the rest in the order of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), table in common.grouped(batches, 1):
            kinds, data = table.column(1).to_pylist(), table.column(3).to_pylist()
            parts = {k: [(p, d) for p, d, j in zip(table.column(2).to_pylist(), data, kinds) if j == k] for k in set(kinds)}
            texts = pa.concat_tables([_unpacked(d) for _, d in parts.pop(TEXTS)]).combine_chunks()
            yield from work(block, texts, parts)
            pa.default_memory_pool().release_unused()

    dealt = rows.select("block", "kind", "part", "data").repartition("block").sortWithinPartitions("block", "kind", "part")
    return dealt.mapInArrow(run, schema)


def _answered(keys: np.ndarray, answers: list[tuple[int, bytes]], slots: int) -> np.ndarray:
    """The bits of sorted keys, put together from the slots' answers."""
    borders = slot_borders(keys, slots)
    out = np.zeros(len(keys), bool)
    for slot, bits in answers:
        out[borders[slot] : borders[slot + 1]] = _mask(bits, int(borders[slot + 1] - borders[slot]))
    return out


def repeats(docs: DataFrame, options: RepeatOptions = RepeatOptions()) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept): runs of removed words as (first, end), and the kept words joined by a space."""
    common.bounded_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(1, -(-size // options.slot_bytes))

    def candidates(block: int, texts: pa.Table, parts: dict) -> Iterator[pa.RecordBatch]:
        words = Words.of(texts["text"].combine_chunks())
        phrases = Phrases.of(words, options)
        keys, place = np.unique(phrases.hash[phrases.standing], return_index=True)
        recurring = _answered(keys, parts.get(RECURRING, []), slots)
        found = located(words, phrases, phrases.standing[place[recurring]], options)
        if not recurring.any():
            return
        span = options.window - options.phrase + 1
        mine = sliding(found, span, np.minimum)[phrases.runs] == phrases.least
        runs = phrases.runs[mine]
        marks = np.zeros(len(words.row), bool)
        marks[runs] = True
        yield _row(CANDIDATES, block, 0, _bits(marks))
        runs_keys, first = np.unique(words.hashes(runs, options.window), return_index=True)
        check = (words.hashes(runs[first], options.window, _OTHER) >> np.uint64(32)).astype(np.uint32)
        owner = words.row[runs[first]]
        ids = texts["doc_id"].cast(pa.int64()).fill_null(_LAST).to_numpy()
        ties = texts["tie"].to_numpy()
        borders = slot_borders(runs_keys, slots)
        for slot in np.flatnonzero(np.diff(borders)).tolist():
            a, b = borders[slot], borders[slot + 1]
            yield _row(RUNS, block, slot, runs_keys[a:b].tobytes() + check[a:b].tobytes(), _owners(owner[a:b], ids, ties))

    def removal(block: int, texts: pa.Table, parts: dict) -> Iterator[pa.RecordBatch]:
        words = Words.of(texts["text"].combine_chunks())
        n = len(words.row)
        gone = np.zeros(n, bool)
        if CANDIDATES in parts:
            runs = np.flatnonzero(_mask(parts[CANDIDATES][0][1], n))
            keys, first, inverse = np.unique(words.hashes(runs, options.window), return_index=True, return_inverse=True)
            again = _answered(keys, parts.get(EARLIER, []), slots)[inverse]
            later = np.ones(len(runs), bool)
            later[first] = False
            cover = np.zeros(n + 1, np.int32)
            np.add.at(cover, runs[again | later], 1)
            np.add.at(cover, runs[again | later] + options.window, -1)
            gone = np.cumsum(cover[:-1]) > 0
        yield _result(texts["doc_id"].combine_chunks(), words, gone)

    made = common.staged(_blocks(docs, slots, options), "kind")
    texts = made.where(F.col("kind") == TEXTS)
    recurring = _answers(made.where(F.col("kind") == PHRASES), RECURRING, _recurs)
    found = common.staged(_per_block(texts.unionByName(recurring), candidates, _SCHEMA), "kind")
    earlier = _answers(found.where(F.col("kind") == RUNS), EARLIER, _has_earlier)
    marked = texts.unionByName(found.where(F.col("kind") == CANDIDATES)).unionByName(earlier)
    return _per_block(marked, removal, f"doc_id {key}, n_words long, n_removed long, removed array<struct<first:long,end:long>>, kept string")


def _result(ids: pa.Array, words: Words, gone: np.ndarray) -> pa.RecordBatch:
    rows = len(words.first) - 1
    first, end = common.spans(gone, words.first) if len(gone) else (np.zeros(0, np.int64),) * 2
    of = np.searchsorted(words.first, first, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(first - words.first[of]), pa.array(end - words.first[of])], ["first", "end"])
    removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, words.first).astype(np.int32)), spans)
    keep = np.flatnonzero(~gone)
    row, length = words.row[keep], (words.end - words.start)[keep]
    lead = np.ones(len(keep), np.int64)  # a space ahead of each kept word but a row's first
    lead[:1] = 0
    lead[1:] = row[1:] == row[:-1]
    at = np.cumsum(length + lead) - length
    out = np.full(int((length + lead).sum()), 0x20, np.uint8)
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.start[keep]] += 1
    inside[words.end[keep]] -= 1
    source = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    out[source + np.repeat(at - words.start[keep], length)] = words.data[source]
    size = np.bincount(row, length + lead, rows).astype(np.int64)
    total = np.diff(words.first)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(total.astype(np.int64)), pa.array((total - np.bincount(row, minlength=rows)).astype(np.int64)), removed, common.strings(out, np.concatenate([[0], np.cumsum(size)]))],
        ["doc_id", "n_words", "n_removed", "removed", "kept"],
    )
