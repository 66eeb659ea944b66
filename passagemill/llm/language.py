"""Language ID by cross-parsing: how few phrases of a language's own text spell a document.

For each language a suffix automaton of labelled text accepts exactly its substrings.  A
document is parsed from left to right into longest matches: a letter that the automaton
cannot follow ends a phrase and starts the next.  The number of phrases, times the bits
that name a place in that language's text, over the document's length estimates the cross
entropy; the smallest wins, ties go to the smaller name.

The automata are flattened into one table of transitions in which a missing one already
holds the restart, so a step is one look-up, and all pieces of a batch of documents step at
once.  Whole texts are parsed, in pieces of ``piece`` letters that each begin a phrase.

Learning takes at most ``per_language`` documents of each language.  Their whole texts are cut
into excerpts of ``excerpt`` letters, and those that hash lowest make up the language's
reference of at most ``reference`` letters, however many languages there are.  Automata of
``block`` letters in all are broadcast at a time; further languages are parsed in further
rounds, which carry the best cost of each document so far.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is every
text if nothing was learned; null ids are never learned from; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm import common

BROADCAST_ROWS = 100_000  # of ids and languages


@dataclass(frozen=True)
class LanguageOptions:
    per_language: int = 60  # documents of each language that are learned from
    excerpt: int = 400
    reference: int = 24_000
    block: int = 400_000  # letters of the references that are parsed against in one round
    piece: int = 512
    modulus: int = 4
    held_out: int = 2  # the remainder of crc32 that is never learned from


def automaton(symbols: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and suffix links of the smallest automaton of all substrings."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go, link


@dataclass
class Parser:
    """The automata of all languages in one table.

    An entry is twice the row of the next state plus one if a phrase ended before the
    letter; ``roots`` are the rows of the start states.
    """

    names: list[str]
    bits: np.ndarray
    symbol: np.ndarray
    table: np.ndarray
    roots: np.ndarray
    piece: int

    @classmethod
    def of(cls, references: dict[str, bytes], piece: int) -> Parser:
        names = sorted(references)
        seen = sorted(set(b"".join(references.values())))
        symbol = np.zeros(256, np.int32)
        symbol[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        tables, roots, base = [], [], 0
        for name in names:
            go, _ = automaton(symbol[np.frombuffer(references[name], np.uint8)].tolist())
            lost = (base + len(go)) * width  # after a letter that this language lacks, a phrase by itself
            start = np.full(width, lost, np.int64)
            for c, to in go[0].items():
                start[c] = (base + to) * width
            rows = np.tile(2 * start + 1, (len(go) + 1, 1))
            rows[0, start == lost] = 2 * lost
            state = np.repeat(np.arange(len(go)), [len(x) for x in go])
            letter = np.fromiter((c for x in go for c in x), np.int64, len(state))
            rows[state, letter] = 2 * width * (base + np.fromiter((to for x in go for to in x.values()), np.int64, len(state)))
            roots.append(base * width)
            tables.append(rows.astype(np.int32))
            base += len(go) + 1
        table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        bits = np.log2([len(references[n]) + 2 for n in names]) if names else np.zeros(0)
        return cls(names, bits, symbol, table, np.array(roots, np.int32), piece)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each row in each language, and the letters of each row."""
        stream, ends = common.letters(data, offsets)
        stream = self.symbol[stream]
        size = np.diff(ends)
        pieces = -(-size // self.piece)
        row = np.repeat(np.arange(len(size)), pieces)
        place = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = ends[:-1][row] + place * self.piece
        length = np.minimum(size[row] - place * self.piece, self.piece)
        order = np.argsort(-length, kind="stable")
        row, start, length = row[order], start[order], length[order]
        languages = len(self.names)
        state = np.repeat(self.roots[:, None], len(row), axis=1) * np.int32(2)
        count = np.ones((languages, len(row)), np.int32)  # the phrase that the end cuts
        active = np.searchsorted(-length, -np.arange(1, self.piece + 1), side="right")
        for t, m in enumerate(active):
            if not m:
                break
            at = state[:, :m] >> 1
            at += stream[start[:m] + t]
            entry = self.table.take(at)
            count[:, :m] += entry & 1
            state[:, :m] = entry
        found = np.stack([np.bincount(row, count[k], len(size)) for k in range(languages)]) if languages else np.zeros((0, len(size)))
        return found, size


def spelled(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    plain = np.concatenate([[0], np.cumsum((common.LOWER[data] >= 0x61) & (common.LOWER[data] <= 0x7A))])[offsets]
    out = np.diff(plain) > 0
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):  # no plain letter, but bytes that may be others
        out[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return out


def weighed(parser: Parser, column: pa.Array, name: list, cost: np.ndarray, total: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """The best language of each text, its cost, and the sum of all languages' odds against it.

    Goes on from those of earlier rounds; ``cost`` is infinite where there was none.
    """
    for first, end, data, offsets in common.texts(column, 1 << 20):  # many pieces in step
        if not parser.names:
            continue
        count, size = parser.phrases(data, offsets)
        costs = count * parser.bits[:, None] / np.maximum(size, 1)
        own = slice(first, end)
        best = costs.argmin(axis=0)
        least = costs[best, np.arange(len(best))]
        sharp = 0.25 * np.minimum(size, 200)
        odds = lambda off: np.exp2(-np.minimum(sharp * off, 60))
        lower = least < cost[own]  # a tie stays with the smaller name, which came before
        new = np.minimum(least, cost[own])
        with np.errstate(invalid="ignore"):
            before = np.where(np.isinf(cost[own]), 0.0, total[own] * odds(np.where(np.isinf(cost[own]), 0.0, cost[own] - new)))
        total[own] = before + odds(costs - new).sum(axis=0)
        cost[own] = new
        for k in np.flatnonzero(lower):
            name[first + k] = parser.names[best[k]]
    return name, cost, total


@dataclass(frozen=True)
class Languages:
    """A reference of each language, bounded by ``LanguageOptions.reference`` bytes."""

    references: dict[str, bytes]

    def blocks(self, options: LanguageOptions) -> list[dict[str, bytes]]:
        """The references in the order of names, ``options.block`` letters at a time."""
        out: list[dict[str, bytes]] = [{}]
        held = 0
        for name in sorted(self.references):
            if out[-1] and held + len(self.references[name]) > options.block:
                out.append({})
                held = 0
            out[-1][name] = self.references[name]
            held += len(self.references[name])
        return out


def train(docs: DataFrame, options: LanguageOptions = LanguageOptions()) -> Languages:
    """References of every language that the labelled documents outside the held-out part have."""
    common.bounded_batches(docs.sparkSession)
    key = common.crc_remainder(F.col("doc_id"), options.modulus)
    known = docs.where(F.col("lang").isNotNull() & (key != options.held_out)).select("doc_id", "lang").distinct()
    chosen = common.staged(common.bounded_sample(known, "lang", options.per_language).select("doc_id", "lang"))
    if chosen.count() <= BROADCAST_ROWS:  # else there are very many languages, and texts are shuffled
        chosen = F.broadcast(chosen)
    read = docs.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]).where("text <> ''")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in common.texts(batch.column(2)):
                stream, ends = common.letters(data, offsets)
                size = np.diff(ends)
                excerpts = -(-size // options.excerpt)
                row = np.repeat(np.arange(len(size)), excerpts)
                place = np.arange(len(row)) - np.repeat(np.cumsum(excerpts) - excerpts, excerpts)
                start = ends[:-1][row] + place * options.excerpt
                end = np.minimum(start + options.excerpt, ends[1:][row])
                taken = pa.array(first + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(place), pa.array([stream[a:b].tobytes() for a, b in zip(start, end)], pa.binary())],
                    ["doc_id", "lang", "place", "excerpt"],
                )

    excerpts = read.mapInArrow(cut, f"doc_id {kind}, lang string, place long, excerpt binary").distinct()
    draw = F.xxhash64(F.lit(17), "doc_id", "place")
    order = Window.partitionBy("lang").orderBy(draw, "doc_id", "place", "excerpt")
    few = excerpts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= -(-options.reference // options.excerpt))
    rows = few.orderBy("lang", "nth").select("lang", "excerpt").toArrow()  # one reference a language
    references: dict[str, list[bytes]] = {}
    for lang, excerpt in zip(rows["lang"].to_pylist(), rows["excerpt"].to_pylist()):
        references.setdefault(lang, []).append(excerpt)
    return Languages({lang: b"".join(parts) for lang, parts in references.items()})


def predictions(docs: DataFrame, languages: Languages, options: LanguageOptions = LanguageOptions()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    held = F.coalesce(common.crc_remainder(F.col("doc_id"), options.modulus) == options.held_out, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text", F.lit("und").alias("lang_pred"), F.lit(float("inf")).alias("cost"), F.lit(0.0).alias("total"))
    key = docs.schema["doc_id"].dataType.simpleString()
    blocks = languages.blocks(options)
    for k, references in enumerate(blocks):
        rows = _round(common.staged(rows) if k else rows, Parser.of(references, options.piece), key, last=k == len(blocks) - 1)
    return rows.select("doc_id", "held_out", "lang_pred", "score")


def _round(rows: DataFrame, parser: Parser, key: str, last: bool) -> DataFrame:
    """One round over all documents; the last one gives scores in place of texts."""
    shared = common.shipped(rows.sparkSession, parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            text = batch.column(2)
            cost, total = (batch.column(k).to_numpy().copy() for k in (4, 5))
            name, cost, total = weighed(own, text, batch.column(3).to_pylist(), cost, total)
            columns, names = [batch.column(0), batch.column(1)], ["doc_id", "held_out"]
            if last:
                data, offsets = common.utf8(text)
                written = spelled(data, offsets) & np.isfinite(cost)
                name = [n if w else "und" for n, w in zip(name, written)]
                score = np.where(written, 1 / np.maximum(total, 1), 0.0)
                columns += [pa.array(name, pa.string()), pa.array(score)]
                names += ["lang_pred", "score"]
            else:
                columns += [text, pa.array(name, pa.string()), pa.array(cost), pa.array(total)]
                names += ["text", "lang_pred", "cost", "total"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"doc_id {key}, held_out boolean, " + ("lang_pred string, score double" if last else "text string, lang_pred string, cost double, total double"))
