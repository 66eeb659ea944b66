"""Token-ID output in training order.

Each text is encoded by a public byte-level BPE vocabulary and closed by the end id; the
stream of a task's documents is cut into sequences of ``length`` ids, the last one padded
with the end id.  The sequences are staged, numbered through all tasks, and a keyed Feistel
permutation of the numbers, walked along its cycle until it lands inside, gives each its
global slot.  Slots are dealt by range into shards of ``shard`` sequences, each sorted by
slot and written by one task: slot ``s`` is record ``s - first`` of shard ``s // shard``, at
``(s - first) * stride`` bytes of the shard's records, so a reader goes on at any slot.

Edge cases: a null text is an empty document, the end id alone; null ids are listed as
null; repeated rows are written as often as they stand; an empty table gives no slot.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import common


@dataclass(frozen=True)
class OrderOptions:
    vocabulary: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"  # lines of base64 token and rank
    end: int = 50_256
    length: int = 1_024
    shard: int = 512
    key: int = 0x5EED
    rounds: int = 4


# Fixed value: the public pattern that cuts texts for byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of texts; made in the task from the broadcast ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        lists = [np.array(self.bpe.encode_ordinary(t), np.int32) for t in texts]
        return np.concatenate([np.zeros(0, np.int32), *lists]), np.array([len(x) for x in lists], np.int64)


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Tokens and ranks; the file is a bounded vocabulary, broadcast to the tasks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def sequences(docs: DataFrame, options: OrderOptions = OrderOptions()) -> DataFrame:
    """(part, number, doc_ids, tokens) of fixed-length sequences; numbers run within each part (task)."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(options.vocabulary))
    key = docs.schema["doc_id"].dataType.simpleString()
    length, kind = options.length, "<u2" if options.end < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = Encoder(ranks.value)
        number, rest, rest_rows, id_type = 0, np.zeros(0, np.int32), np.zeros(0, np.int64), None
        held: list = []  # the documents that ``rest`` comes from

        def cut(tokens: np.ndarray, rows: np.ndarray, names: list) -> pa.RecordBatch:
            nonlocal number
            whole = len(tokens) // length
            blocks = tokens.astype(kind).reshape(whole, length)
            owners = rows.reshape(whole, length)
            lists = [[names[k] for k in dict.fromkeys(o[np.append(True, o[1:] != o[:-1])].tolist()) if k >= 0] for o in owners]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(np.full(whole, part, np.int32)), pa.array(np.arange(number, number + whole)), pa.array(lists, pa.list_(id_type)), pa.array([b.tobytes() for b in blocks], pa.binary())],
                ["part", "number", "doc_ids", "tokens"],
            )
            number += whole
            return batch

        for batch in batches:
            id_type = batch.column(0).type
            for first, end in common.steps(common.utf8(batch.column(1))[1]):
                ids, counts = encoder.encode([t or "" for t in batch.column(1).slice(first, end - first).to_pylist()])
                closed = np.insert(ids, np.cumsum(counts), options.end)
                names = held + batch.column(0).slice(first, end - first).to_pylist()
                rows = np.concatenate([rest_rows, np.repeat(np.arange(len(held), len(names)), counts + 1)])
                tokens = np.concatenate([rest, closed])
                whole = len(tokens) // length * length
                if whole:
                    yield cut(tokens[:whole], rows[:whole], names)
                rest, left = tokens[whole:], rows[whole:]
                used, rest_rows = np.unique(left, return_inverse=True)
                held = [names[k] for k in used]
        if len(rest):
            pad = length - len(rest)
            yield cut(np.append(rest, np.full(pad, options.end, np.int32)), np.append(rest_rows, np.full(pad, -1)), held)

    return docs.select("doc_id", "text").mapInArrow(run, f"part int, number long, doc_ids array<{key}>, tokens binary")


def feistel(numbers: np.ndarray, total: int, options: OrderOptions = OrderOptions()) -> np.ndarray:
    """Slots of sequence numbers: a keyed permutation of 0..total-1.

    A balanced Feistel network permutes the next even number of bits; numbers that land at
    or above ``total`` are permuted again until inside, which keeps it one to one.
    """
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = common.mix(np.arange(1, options.rounds + 1, dtype=np.uint64) + np.uint64(options.key))
    out = numbers.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & low
        for k in keys:
            left, right = right, left ^ (common.mix(right ^ k) >> np.uint64(20) & low)
        out[walk] = left << np.uint64(half) | right
        walk = walk[out[walk] >= total]
    return out.astype(np.int64)


def training_order(docs: DataFrame, options: OrderOptions = OrderOptions()) -> DataFrame:
    """(slot, shard, place, n_tokens, doc_ids, tokens): all sequences, each shard in one file in the order of its slots.

    ``place`` is the byte at which the record stands in its shard.
    """
    common.bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    made = common.staged(sequences(docs, options))
    parts = made.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").toArrow()  # one row per task
    counts = parts["n"].to_numpy()
    total = int(counts.sum())
    base = np.zeros(int(parts["part"].to_numpy().max(initial=-1)) + 1, np.int64)
    base[parts["part"].to_numpy()] = np.cumsum(counts) - counts
    bases = spark.sparkContext.broadcast(base)
    key = made.schema["doc_ids"].dataType.simpleString()
    stride = options.length * (2 if options.end < 1 << 16 else 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = bases.value[batch.column(0).to_numpy()] + batch.column(1).to_numpy()
            slots = feistel(number, total, options)
            shard = slots // options.shard
            n = pa.array(np.full(len(slots), options.length, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(shard), pa.array((slots - shard * options.shard) * stride), n, batch.column(2), batch.column(3)], ["slot", "shard", "place", "n_tokens", "doc_ids", "tokens"])

    placed = made.mapInArrow(run, f"slot long, shard long, place long, n_tokens int, doc_ids {key}, tokens binary")
    return placed.repartition("shard").sortWithinPartitions("slot")


def write(ordered: DataFrame, path: str) -> None:
    """The shards as files below ``path``, a folder for each."""
    ordered.write.partitionBy("shard").parquet(path)


def read_from(ordered: DataFrame, first: int, options: OrderOptions = OrderOptions()) -> DataFrame:
    """Sequences from a slot on, in order; whole shards before it are not read."""
    return ordered.where((F.col("shard") >= first // options.shard) & (F.col("slot") >= first)).orderBy("slot")
