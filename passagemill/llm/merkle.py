"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf: the SHA-256 of its fields, each with its length.  Leaves of a group
(a language) form a tree in the order of their ids, the groups' roots form one more tree,
and its root stands for the dataset.  A row's witness, the siblings on its way to the root,
proves that it belongs there.

``Append`` takes leaves one by one and keeps only open subtrees, perfect ones of falling
height, each with the partial witnesses of its leaves.  A subtree that gets its sibling
extends the witnesses of both sides and joins it; closing lifts the last, incomplete run.
Spark deals the leaves of a group into aligned blocks, appends each block in one task,
and treats the blocks' roots as further appends: they are leaves of the next, shorter round,
until each group has one root.  A leaf's whole witness is that of its block, then of its
block's root, and so on; the parts meet in joins on (tree, block), a block's size at most.

Order and ties: groups and ids ascend, null first; rows that repeat an id follow in the
order of their digests, and rows equal in all fields are interchangeable.  Null fields are
written as ``-``, so empty and null differ.  An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm import common


@dataclass(frozen=True)
class ManifestOptions:
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "lang"
    key: str = "doc_id"
    block_height: int = 10  # blocks of 2 ** height leaves


ALONE, LEFT, RIGHT = 0, 1, 2  # on which side of the way the sibling stands
ENTRY = 33  # bytes of a witness' entry: side and digest


def combined(*digests: bytes) -> bytes:
    """The node above raw digests, which are hashed as hexadecimal text."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


class Append:
    """A tree that grows by one leaf after another; ``witness[k]`` are the entries known for leaf ``k``."""

    def __init__(self, room: int, height: int = 0):
        self.open: list[tuple[int, bytes, int, int]] = []  # height, root, first and end leaf
        self.witness = np.zeros((room, max(height, room.bit_length()), ENTRY), np.uint8)
        self.size = 0

    def _extend(self, first: int, end: int, height: int, side: int, digest: bytes) -> None:
        self.witness[first:end, height] = np.frombuffer(bytes([side]) + digest, np.uint8)

    def _merge(self) -> None:
        """Joins the last subtree with the one before while they have the same height."""
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            height, right, middle, end = self.open.pop()
            _, left, first, _ = self.open.pop()
            self._extend(first, middle, height, RIGHT, right)
            self._extend(middle, end, height, LEFT, left)
            self.open.append((height + 1, combined(left, right), first, end))

    def add(self, leaf: bytes) -> None:
        self.open.append((0, leaf, self.size, self.size + 1))
        self.size += 1
        self._merge()

    def close(self, height: int | None = None) -> tuple[bytes, int]:
        """The root and its height: the least one, or the given one that the tree's other blocks have."""
        while len(self.open) > 1 or (height is not None and self.open[0][0] < height):
            level, root, first, end = self.open.pop()
            self.open.append((level + 1, combined(root), first, end))  # ALONE is all zeros: nothing to write
            self._merge()
        return self.open[0][1], self.open[0][0]


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    node = leaf
    for k in range(0, len(witness), ENTRY):
        side, other = witness[k], witness[k + 1 : k + ENTRY]
        node = combined(node) if side == ALONE else combined(other, node) if side == LEFT else combined(node, other)
    return node


def siblings(witness: bytes) -> list[bytes]:
    return [witness[k + 1 : k + ENTRY] for k in range(0, len(witness), ENTRY) if witness[k] != ALONE]


# ---------------------------------------------------------------- leaves


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(docs: DataFrame, options: ManifestOptions = ManifestOptions(), **changed: Column) -> Column:
    """The raw digest of a row's fields, some of them replaced by other columns."""
    return F.unhex(F.sha2(F.concat(*[_field(changed.get(f, docs[f])) for f in options.fields]), 256))


# ---------------------------------------------------------------- trees


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with (part, run, at), staged: runs of equal ``group`` within range partitions, places within runs."""
    names, schema = rows.columns, rows.schema
    g = names.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, at, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(g)
            head = pa.concat_arrays([last if last is not None else values.slice(0, 1), values])
            before, now = head.slice(0, len(values)), head.slice(1)
            same = pc.or_kleene(pc.and_(pc.is_null(before), pc.is_null(now)), pc.fill_null(pc.equal(before, now), False))
            fresh = ~same.to_numpy(zero_copy_only=False)
            runs = number + np.cumsum(fresh)
            index = np.arange(len(fresh))
            start = np.maximum.accumulate(np.where(fresh, index, -1))
            places = np.where(start < 0, at + index, index - start)
            number, at, last = int(runs[-1]), int(places[-1]) + 1, values.slice(len(values) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(runs), part, np.int32)), pa.array(runs.astype(np.int32)), pa.array(places.astype(np.int64))], [*names, "part", "run", "at"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return common.staged(dealt.mapInArrow(run, f"{kinds}, part int, run int, at long"))


def _appended(nodes: DataFrame, carry: list[str], height: int) -> tuple[DataFrame, DataFrame]:
    """(carry, tree, block, witness) of all nodes and (tree, pos, total, digest) of the blocks' roots, staged.

    ``nodes`` has (tree, pos, total, digest) and the columns to carry.
    """
    common.bounded_batches(nodes.sparkSession)
    width = 1 << height
    types = {f.name: f.dataType for f in nodes.schema.fields}
    rows = nodes.select("tree", F.shiftright("pos", height).alias("block"), "total", "digest", "pos", *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block, total), table in common.grouped(batches, 3):
            size = table.num_rows
            grown = Append(size, height)
            for leaf in table.column("digest").to_pylist():
                grown.add(leaf)
            root, levels = grown.close(height if total > width else None)
            witness = pa.array([w.tobytes() for w in grown.witness[:, :levels].reshape(size, -1)], pa.binary())
            carried = [table.column(c).combine_chunks() for c in carry]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, tree)), pa.array(np.full(size, block)), pa.nulls(size, pa.int64()), witness, *carried, pa.array(np.zeros(size, np.int32))],
                ["tree", "block", "total", "bytes", *carry, "kind"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree]), pa.array([block]), pa.array([-(-total // width)]), pa.array([root], pa.binary()), *[pa.nulls(1, c.type) for c in carried], pa.array([1], pa.int32())],
                ["tree", "block", "total", "bytes", *carry, "kind"],
            )

    kinds = "".join(f"`{c}` {types[c].simpleString()}, " for c in carry)
    ordered = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    made = common.staged(ordered.mapInArrow(run, f"tree long, block long, total long, bytes binary, {kinds}kind int"), "kind")
    inner = made.where("kind = 0").select("tree", "block", F.col("bytes").alias("witness"), *carry)
    roots = made.where("kind = 1").select("tree", F.col("block").alias("pos"), "total", F.col("bytes").alias("digest"))
    return inner, roots


def grow(rows: DataFrame, group: str, order: list[str], height: int) -> tuple[DataFrame, DataFrame]:
    """Trees over the ``digest`` of rows, one for each value of ``group``.

    Gives ``rows`` without ``group`` but with (tree, block, witness, rest), whose two parts
    make up the whole witness, and (tree, digest) of the roots; trees are numbered in the
    order of their groups.
    """
    numbered = _numbered(rows, group, [group, *order])
    spans = numbered.groupBy("part", "run").agg(F.first(group).alias("g"), F.count("*").alias("n"))
    own = Window.partitionBy("g")  # a row for each task that has the group
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    number = F.shiftleft(F.col("part").cast("long"), 32) + F.col("run")
    spans = common.staged(
        spans.select("part", "run", F.min(number).over(own).alias("tree"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(own).alias("total"))
    )
    most = spans.agg(F.max("total")).first()[0] or 0
    carry = [c for c in rows.columns if c != group]
    placed = numbered.join(spans, ["part", "run"]).withColumn("pos", F.col("base") + F.col("at"))
    nodes, above = _appended(placed.select("tree", "pos", "total", "digest", *[c for c in carry if c != "digest"]), [c for c in carry if c != "digest"], height)
    levels = []
    while most > 1 << height:
        most = -(-most >> height)
        inner, above = _appended(above.withColumn("node", F.col("pos")), ["node"], height)
        levels.append(inner)
    rest = None
    for inner in reversed(levels):  # from the root downwards, each level a small part of the one below
        if rest is None:
            rest = inner.select("tree", "node", F.col("witness").alias("rest"))
        else:
            up = rest.select("tree", F.col("node").alias("block"), F.col("rest").alias("more"))
            rest = inner.join(up, ["tree", "block"]).select("tree", "node", F.concat("witness", "more").alias("rest"))
    if rest is None:
        nodes = nodes.withColumn("rest", F.lit(b""))
    else:
        nodes = nodes.join(rest.withColumnRenamed("node", "block"), ["tree", "block"])
    return nodes, above.select("tree", "digest")


def manifest(docs: DataFrame, options: ManifestOptions = ManifestOptions(), presented: Column | None = None) -> DataFrame:
    """(key, leaf, presented, subroot, root, witness) of every row, digests as bytes.

    ``presented`` is a leaf digest that somebody shows later on and that ``verified`` holds
    against the root; where it is null, the row's own leaf is.
    """
    shown = F.lit(None).cast("binary") if presented is None else presented
    rows = docs.select(F.col(options.group).alias("g"), F.col(options.key).alias("key"), leaf_digest(docs, options).alias("digest"), shown.alias("presented"))
    rows = rows.withColumn("leaf", F.col("digest"))
    nodes, roots = grow(rows, "g", ["key", "digest"], options.block_height)
    tops, top = grow(roots.withColumn("one", F.lit(0)).withColumn("subroot", F.col("digest")).withColumnRenamed("tree", "of"), "one", ["of"], options.block_height)
    root = top.first()  # one row
    tops = tops.select(F.col("of").alias("tree"), "subroot", F.concat("witness", "rest").alias("last"))
    whole = reduce(lambda a, b: F.concat(a, b), [F.col("witness"), F.col("rest"), F.col("last")])
    joined = nodes.join(tops, "tree")
    return joined.select("key", "leaf", "presented", "subroot", F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root"), whole.alias("witness"))


def verified(rows: DataFrame) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of a manifest's rows, digests as hexadecimal text."""
    common.bounded_batches(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, shown, subroot, root, witness = (batch.column(k).to_pylist() for k in range(1, 6))
            folded = [fold(s if s is not None else f, w) for f, s, w in zip(leaf, shown, witness)]
            text = lambda digests: pa.array([d.hex() for d in digests], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), text(leaf), text(subroot), text(root), text(combined(*siblings(w)) for w in witness), text(folded), pa.array([f == r for f, r in zip(folded, root)], pa.bool_())],
                ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    read = rows.select("key", "leaf", "presented", "subroot", "root", "witness")
    return read.mapInArrow(run, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def audit(docs: DataFrame, options: ManifestOptions = ManifestOptions()) -> DataFrame:
    """Builds the manifest, adds 1 to ``n_chars`` of every seventh id's row, and verifies all rows as they stand then."""
    tampered = F.coalesce(F.crc32(F.col(options.key).cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    more = leaf_digest(docs, options, n_chars=docs["n_chars"].cast("decimal(20,0)") + 1)
    rows = verified(manifest(docs, options, F.when(tampered, more)))
    return rows.withColumnRenamed("key", options.key)
