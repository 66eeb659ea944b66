"""N-gram Jaccard join by rare-first prefix filtering, reported as components.

A document's set is its distinct shingles of ``width`` words.  Texts with equal sets are
one class, told by a 64-bit sum over the set.  If two sets overlap enough, their prefixes
do: the ``floor((1 - t) n) + 1`` rarest shingles of a set of n.  Rarity comes from counts
over the whole table, held in hashed counters; any fixed order gives the same links, a
rarer-first one gives shorter lists.

Classes that share a prefix shingle are candidates if they pass three filters.  Length and
position: at the first shingle that two prefixes share, what follows either place must
suffice.  Suffix: the whole sets are spread over hashed cells and counted modulo 16; the
distance of two such histograms never exceeds the symmetric difference, which bounds the
overlap from above as a recursive suffix filter does.  Each pair of classes is then verified once, on whole sets.

Lists never expand into all pairs.  First each class of a list is tried against one class
that the list's hash draws from it; links found so join classes into components.  Only
pairs that still lie in different components are then tried, in blocks of bounded size, and
leave a task only if they pass the filters.  Links inside a component are not counted:
they cannot change it.

Edge cases: null texts and texts without words have an empty set and are linked with
nothing; fewer words than ``width`` are one shingle; null ids count as the largest; repeated
rows give repeated results; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm import common


CELLS = 256  # of a set's histogram


@dataclass(frozen=True)
class JoinOptions:
    width: int = 3
    percent: int = 90  # of the union that two linked sets share at least
    buckets_log2: int = 18  # counters of rarity
    block: int = 1_024  # members of a list that one task compares at once with as many others
    bloom_log2: int = 22  # bits of the filter that spares the shuffle texts nobody asked for


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges with the distinct shingles of each row in rising order: hashes, rows, and where each row starts."""
    for first, end, data, offsets in common.texts(column):
        words, _, begin = common.word_hashes(data, offsets, common.NON_SPACE)
        hashes, rows = common.shingles(words, begin, width)
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        hashes, rows = hashes[keep], rows[keep]
        yield first, end, hashes, rows, np.searchsorted(rows, np.arange(end - first + 1))


def _classes(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A number that stands for each row's set."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(common.mix(hashes ^ np.uint64(0xA0761D6478BD642F)), out=sums[1:])
    return common.mix(sums[begin[1:]] - sums[begin[:-1]] + np.diff(begin).astype(np.uint64)).view(np.int64)


def _histograms(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How each row's set spreads over the cells, counted modulo 16."""
    cell = (common.mix(hashes) & np.uint64(CELLS - 1)).astype(np.int64)
    return (np.bincount(rows * CELLS + cell, minlength=n * CELLS) & 15).astype(np.uint8).reshape(n, CELLS)


def _packed(histograms: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in histograms[:, 0::2] << 4 | histograms[:, 1::2]]


def _unpacked(rows: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), CELLS // 2)
    return np.stack([flat >> 4, flat & 15], axis=2).reshape(len(rows), CELLS).astype(np.int8)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At most the number of elements in one of two sets: distances on a ring of 16, summed over the cells."""
    off = np.abs(x - y)
    return np.minimum(off, 16 - off).sum(axis=1, dtype=np.int64)


def _fresh(classes: np.ndarray, begin: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows are the first of their class in this task."""
    out = np.zeros(len(classes), bool)
    for k, (c, n) in enumerate(zip(classes.tolist(), np.diff(begin))):
        if n and c not in seen:
            seen.add(c)
            out[k] = True
    return out


def profiles(docs: DataFrame, options: JoinOptions) -> DataFrame:
    """(doc_id, hash of the text, n_shingles, class, histogram) of every row, and as rows with a bucket the counters of each task."""
    key = docs.schema["doc_id"].dataType.simpleString()
    shift = np.uint64(64 - options.buckets_log2)
    names = ["doc_id", "hash", "n_shingles", "class", "histogram", "bucket", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counts = np.zeros(1 << options.buckets_log2, np.int64)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for first, end, hashes, rows, begin in _sets(batch.column(2), options.width):
                classes, n = _classes(hashes, begin), end - first
                fresh = _fresh(classes, begin, seen)
                counts += np.bincount((hashes[fresh[rows]] >> shift).astype(np.int64), minlength=len(counts))
                empty = np.diff(begin) == 0
                spread = [h if f else None for h, f in zip(_packed(_histograms(hashes, rows, n)), fresh)]
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(np.diff(begin)), pa.array(classes, mask=empty), pa.array(spread, pa.binary()), none, none], names)
        at = np.flatnonzero(counts)
        for part in np.array_split(at, -(-len(at) // 100_000)) if len(at) else []:
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), kind), none, none, none, pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(counts[part])], names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(run, f"doc_id {key}, hash long, n_shingles long, class long, histogram binary, bucket long, count long")


def _prefixes(docs: DataFrame, rank: np.ndarray, options: JoinOptions) -> DataFrame:
    """(token, class, size): each class's rarest shingles, once per task; ``size`` holds n and the place in the prefix."""
    ranks = docs.sparkSession.sparkContext.broadcast(rank)
    shift = np.uint64(64 - options.buckets_log2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, hashes, rows, begin in _sets(batch.column(0), options.width):
                classes = _classes(hashes, begin)
                use = _fresh(classes, begin, seen)[rows]
                hashes, rows = hashes[use], rows[use]
                order = np.lexsort((hashes, ranks.value[(hashes >> shift).astype(np.int64)], rows))
                hashes, rows = hashes[order], rows[order]
                size = np.diff(begin)
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                keep = place < (100 - options.percent) * size[rows] // 100 + 1
                hashes, rows, place = hashes[keep], rows[keep], place[keep]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(classes[rows]), pa.array(size[rows] << 32 | place)], ["token", "class", "size"])

    return docs.select("text").mapInArrow(run, "token long, class long, size long")


def _enough(most: Column, together: Column, percent: int) -> Column:
    """Whether sets of ``together`` elements in sum may be linked if they share ``most``."""
    return (100 + percent) * most >= percent * together


def _close(pairs: DataFrame, classes: DataFrame, options: JoinOptions) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter."""
    percent = options.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            together = batch.column(2).to_numpy()
            most = (together - _apart(_unpacked(batch.column(3).to_pylist()), _unpacked(batch.column(4).to_pylist()))) // 2
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * most >= percent * together))

    side = lambda c, n, h: classes.select(F.col("class").alias(c), F.col("n").alias(n), F.col("histogram").alias(h))
    both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    return both.select("a", "b", (F.col("n") + F.col("m")).alias("together"), "x", "y").mapInArrow(run, "a long, b long")


def _asked(rows: DataFrame, hash_: str, wanted: DataFrame, options: JoinOptions) -> DataFrame:
    """The rows with ``asked``: false only where the hash is surely none of ``wanted`` (column h).

    A filter of ``2 ** bloom_log2`` bits, broadcast as 64-bit words: a table of bounded size.
    """
    mask, words = (1 << options.bloom_log2) - 1, (1 << (options.bloom_log2 - 6)) - 1
    bits = wanted.selectExpr(f"cast(shiftright(h & {mask}L, 6) AS int) AS _word", "shiftleft(1L, cast(h & 63L AS int)) AS bit")
    bits = bits.groupBy("_word").agg(F.bit_or("bit").alias("_bits"))
    placed = rows.withColumn("_at", F.expr(f"cast(shiftright({hash_}, 6) & {words}L AS int)"))
    joined = placed.join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left")
    asked = F.expr(f"coalesce((shiftrightunsigned(_bits, cast({hash_} & 63L AS int)) & 1L) = 1L, false)")
    return joined.withColumn("asked", asked).drop("_at", "_word", "_bits")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, options: JoinOptions) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap enough."""
    pairs = common.staged(pairs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    readers = common.staged(classes.join(needed, "class").select(F.col("class").alias("wanted"), F.col("reader.doc_id").alias("r"), F.col("reader.hash").alias("h")))
    same = (F.col("hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("r"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    texts = _asked(hashed, "hash", readers, options).where("asked").join(readers, same).select("wanted", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One set for each class; a row that repeats the class's document is passed over."""
        seen: set[int] = set()
        for batch in batches:
            fresh = [w not in seen and not seen.add(w) for w in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for first, end, hashes, _, begin in _sets(batch.column(1), options.width):
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), lists], ["class", "shingles"])

    sets = common.staged(texts.mapInArrow(run, "class long, shingles array<long>").dropDuplicates(["class"]))
    left = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(_enough(shared, F.size("x") + F.size("y"), options.percent)).select("a", "b")


def _remaining(lists: DataFrame, options: JoinOptions) -> DataFrame:
    """Candidate pairs of different components in lists of (token, class, size, root, members, histogram).

    A list is dealt into blocks, every two blocks meet in one task, and only pairs that
    pass all filters leave it.
    """
    blocks = F.ceil(F.col("members") / options.block).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    dealt = lists.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pair = F.shiftleft(F.least("own", "other").cast("long"), 32) + F.greatest("own", "other")
    dealt = dealt.select("token", pair.alias("pair"), "own", "class", "size", "root", "histogram")
    percent = options.percent

    def group(rows: pa.Table) -> Iterator[tuple[int, int]]:
        size = rows.column("size").to_numpy()
        order = np.argsort(size, kind="stable")
        own, names, roots = (rows.column(c).to_numpy()[order].astype(np.int64) for c in ("own", "class", "root"))
        n, place = size[order] >> 32, size[order] & ((1 << 32) - 1)
        pair = rows.column("pair")[0].as_py()
        spread = _unpacked(rows.column("histogram").to_pylist())[order]
        for k in range(len(n) - 1):
            rest = np.arange(k + 1, np.searchsorted(n, n[k] * 100 // percent, side="right"))
            if pair >> 32 != pair & ((1 << 32) - 1):
                rest = rest[own[rest] != own[k]]
            rest = rest[roots[rest] != roots[k]]
            rest = rest[(100 + percent) * np.minimum(n[k] - place[k], n[rest] - place[rest]) >= percent * (n[k] + n[rest])]
            if len(rest):
                apart = _apart(spread[rest], spread[k])
                rest = rest[(100 + percent) * ((n[k] + n[rest] - apart) // 2) >= percent * (n[k] + n[rest])]
            for other in names[rest].tolist():
                yield min(int(names[k]), other), max(int(names[k]), other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive sorted; the last group of a batch waits for the next batch."""
        held: pa.Table | None = None

        def done(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("token", "pair")], axis=1)
            borders = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            ends = borders if last else borders[:-1]
            found = {pair for a, b in zip(ends[:-1], ends[1:]) if b - a > 1 for pair in group(table.slice(a, b - a))}
            batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])
            return batch, None if last else table.slice(borders[-2])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                batch, held = done(table if held is None else pa.concat_tables([held, table]), False)
                yield batch
        if held is not None:
            yield done(held, True)[0]

    ordered = dealt.repartition("token", "pair").sortWithinPartitions("token", "pair")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _components(docs: DataFrame, options: JoinOptions) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash, n_shingles, class) of every row, and (class, reader, root) of every class that is not empty.

    ``reader`` names the smallest row of a class: by id, nulls last, then by the text's hash.
    """
    common.bounded_batches(docs.sparkSession)
    found = common.staged(profiles(docs, options))
    rows = found.where("bucket is null").select("doc_id", "hash", "n_shingles", "class", "histogram")
    counts = found.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()  # one row per bucket
    rank = np.zeros(1 << options.buckets_log2, np.int64)
    rank[counts["bucket"].to_numpy()] = counts["count"].to_numpy()
    reader = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    classes = rows.where("class is not null").groupBy("class").agg(F.min(reader).alias("reader"), F.first("n_shingles").alias("n"), F.first("histogram", ignorenulls=True).alias("histogram"))
    classes = common.staged(classes)

    listed = _prefixes(docs, np.minimum(rank, 2**31 - 1).astype(np.int32), options)
    whole = Window.partitionBy("token")
    drawn = F.struct(F.xxhash64("token", "class").alias("h"), F.col("class").alias("leader"), F.col("size").alias("leader_size"))
    lists = listed.withColumn("least", F.min("class").over(whole)).withColumn("most", F.max("class").over(whole)).withColumn("shortest", F.min("size").over(whole)).withColumn("drawn", F.min(drawn).over(whole))
    high, low = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND((1 << 32) - 1)
    lists = lists.where("least <> most").select("token", "class", high("size").alias("n"), low("size").alias("place"), high("shortest").alias("shortest"), "drawn.leader", high("drawn.leader_size").alias("leader_n"), low("drawn.leader_size").alias("leader_place"))
    # a place from which no set of the list is short enough to be linked with
    lists = lists.where(_enough(F.col("n") - F.col("place"), F.col("n") + F.greatest("shortest", F.ceil(F.col("n") * options.percent / 100)), options.percent))
    lists = common.staged(lists.drop("shortest"))

    near = _enough(F.least(F.col("n") - F.col("place"), F.col("leader_n") - F.col("leader_place")), F.col("n") + F.col("leader_n"), options.percent)
    first = lists.where(F.col("class") != F.col("leader")).where(near).select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct()
    first = common.staged(first)
    links = common.staged(_verified(_close(first, classes, options), docs, classes, options))
    roots = common.components(links, "a", "b")

    members = lists.select("token", "class", (F.shiftleft(F.col("n"), 32) + F.col("place")).alias("size"), (F.col("class") == F.col("leader")).alias("leads")).distinct().join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    members = members.withColumn("root", F.coalesce("root", "class"))
    open_ = Window.partitionBy("token")
    members = members.withColumn("x", F.min("root").over(open_)).withColumn("y", F.max("root").over(open_)).withColumn("members", F.count("*").over(open_)).withColumn("led", F.max("leads").over(open_))
    members = members.where("x <> y AND (members > 2 OR NOT led)").drop("x", "y", "leads", "led")  # a list of two with its leader was tried whole
    second = _remaining(members.join(classes.select("class", "histogram"), "class"), options).join(first, ["a", "b"], "left_anti")
    more = _verified(second, docs, classes, options)
    roots = common.components(links.unionByName(common.staged(more)), "a", "b")

    of = classes.select("class", "reader").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    return rows.drop("histogram"), of


def linked(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component's id is its smallest doc_id."""
    rows, of = _components(docs, options)
    named = of.join(of.groupBy("root").agg(F.min("reader.doc_id").alias("component_id")), "root").select("class", "component_id")
    return rows.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """Of each component the smallest row, by id with nulls last, then by its text's hash; all rows without words.

    Rows are told apart by id and text: different texts under one id are decided on each by
    itself, and copies without id are one group.  Rows that repeat id and text give the
    smallest of them.  Only rows that a bounded filter cannot rule out are shuffled.
    """
    rows, of = _components(docs, options)
    kept = of.join(of.groupBy("root").agg(F.min("reader").alias("kept")), "root").select("class", "kept")
    keys = rows.join(kept, "class").groupBy("doc_id", "hash").agg(F.first("kept").alias("kept"), F.count("*").alias("rows"))
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("hash") == F.col("kept.hash"))
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_text"), stays.alias("_stays"), "rows")
    doubtful = common.staged(keys.where("rows > 1 or not _stays").select("_id", "_text", "_stays", F.xxhash64("_id", "_text").alias("h")))
    text = F.xxhash64("text")
    named = docs.select(F.struct(*docs.columns).alias("_row"), text.alias("_text"), F.xxhash64("doc_id", text).alias("_hash"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_words"))
    named = _asked(named, "_hash", doubtful, options)
    clear = named.where("not asked or not _words").select("_row.*")
    once = named.where("asked and _words").groupBy(F.col("_row.doc_id").alias("_own"), F.col("_text").alias("_hash")).agg(F.min("_row").alias("_row"))
    gone = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    return clear.unionByName(once.join(doubtful.where("not _stays"), gone, "left_anti").select("_row.*"))
