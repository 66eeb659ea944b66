"""What the operators share: staged tables, hashed words in Arrow batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

T = TypeVar("T")
CHUNK_BYTES = 1 << 18  # of text that one vectorised step works on; a longer text is a step of its own


# ---------------------------------------------------------------- staged tables


_LOCAL: list[str] = []  # the folder of a local session
_NOTED: list[list[str]] = []  # one list for each ``noted_tables`` block that is open


def _local_folder() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="llm-"))
    return _LOCAL[0]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a local session (tests) may do without the setting; on a cluster a folder of
    one machine would hide the files from the others, so a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once and read back, so that later steps start from files all executors see."""
    path = shared_folder(df.sparkSession)
    for noted in _NOTED:
        noted.append(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, folders: list[str], unless_read_by: DataFrame | None = None) -> list[str]:
    """Delete staged tables; those that a DataFrame still reads stay and are given back."""
    read = unless_read_by.inputFiles() if unless_read_by is not None and folders else []
    needed = [f for f in folders if any(f.rsplit("/", 1)[1] in path for path in read)]
    for folder in set(folders) - set(needed):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return needed


@contextmanager
def noted_tables() -> Iterator[list[str]]:
    """The folders of tables that are staged inside the ``with`` block."""
    own: list[str] = []
    _NOTED.append(own)
    try:
        yield own
    finally:
        _NOTED[:] = [x for x in _NOTED if x is not own]


def shipped(spark: SparkSession, value: T) -> Callable[[], T]:
    """A broadcast of any value, read by calling the result in a task.

    Broadcasts name classes by their module, which workers may lack; this one carries the
    code of the package's classes along.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's default, as texts are long; another setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


# ---------------------------------------------------------------- rows


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(key.cast("string")) % modulus


def training_labels(labels: DataFrame, label: str, modulus: int) -> DataFrame:
    """(doc_id, y boolean) of labelled rows outside the held-out remainder 0; repeated labels of an id count as 1 if any is."""
    rows = labels.where(F.col(label).isNotNull() & (crc_remainder(F.col("doc_id"), modulus) != 0))
    return rows.groupBy("doc_id").agg((F.max(F.col(label) == 1)).alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, per_label: int) -> DataFrame:
    """(doc_id, text, y, weight): at most ``per_label`` training documents of each label.

    ``weight`` is the number of labelled rows that a sampled row stands for, so the
    sample keeps the labels' shares.  An id that documents repeat counts once, with its
    smallest text.
    """
    marked = training_labels(labels, label, modulus)
    totals = marked.groupBy("y").agg(F.count("*").alias("n"))
    chosen = bounded_sample(marked, "y", per_label).join(F.broadcast(totals), "y")
    chosen = chosen.select("doc_id", "y", (F.col("n") / F.least(F.col("n"), F.lit(per_label))).alias("weight"))
    read = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * per_label short rows at most
    return read.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("weight").alias("weight"))


def bounded_sample(rows: DataFrame, stratum: str, per_stratum: int) -> DataFrame:
    """At most ``per_stratum`` rows of each value of ``stratum``, the ones whose ``doc_id`` hashes lowest.

    The strata are counted first and only rows with a hash below twice the needed share
    are ranked, so a stratum that holds most rows does not meet in one task.
    """
    totals = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 11) / float(1 << 53)
    near = rows.join(totals, F.col(stratum) == F.col("_s")).where(unit * F.col("_n") < 2 * per_stratum + 64)
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id")
    return near.withColumn("_place", F.row_number().over(order)).where(f"_place <= {int(per_stratum)}").drop("_place", "_s", "_n")


# ---------------------------------------------------------------- bytes of Arrow columns


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def texts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a text column, step by step."""
    data, offsets = utf8(column)
    for start, stop in steps(offsets, limit):
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
    pa.default_memory_pool().release_unused()  # workers live on beside the next stage's


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A text column of UTF-8 bytes and row offsets."""
    kind, width = (pa.string(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(width).tobytes()), pa.py_buffer(data.tobytes())])


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Runs of rows with equal first ``keys`` columns (whole numbers), one table each."""
    held: list[pa.RecordBatch] = []
    mark: tuple[int, ...] = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(keys)], axis=1)
        borders = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for a, b in zip(borders, borders[1:]):
            now = tuple(values[a].tolist())
            if held and now != mark:
                yield mark, pa.Table.from_batches(held).combine_chunks()
                held = []
            mark = now
            held.append(batch.slice(a, b - a))
    if held:
        yield mark, pa.Table.from_batches(held).combine_chunks()


# ---------------------------------------------------------------- hashing

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURNS = np.arange(65, dtype=np.uint64) * _ODD  # one for each place of a shingle


def mix(values: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every bit (xor-shift and multiply)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = np.uint64(0xB5AD4ECEDA1CE2AB)  # odd, and 3 modulo 8
_BASE_INVERSE = np.uint64(pow(0xB5AD4ECEDA1CE2AB, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS[0], _POWERS[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte keys times powers, from which ``span_hashes`` reads any span's hash."""
    powers, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * powers[: len(data)], out=sums[1:])
    return sums


def value_sums(values: np.ndarray) -> np.ndarray:
    """As ``prefix_sums`` for a row of 64-bit values, such as the hashes of words."""
    powers, _ = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    _, inverse = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NON_SPACE = ~SPACES
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True  # of lower-cased text


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes; a run never crosses a row border."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(mask) + 1, bool)
    border[offsets] = True
    before, after = np.empty_like(mask), np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    after[-1], after[:-1] = False, mask[1:]
    return np.flatnonzero(mask & (~before | border[:-1])), np.flatnonzero(mask & (~after | border[1:])) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (runs of ``of_word`` bytes of lower-cased text), their starts, and the first word of each row."""
    low = LOWER[data]
    starts, ends = spans(of_word[low], offsets)
    return span_hashes(prefix_sums(low), starts, ends), starts, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words of a row, and the row of each.

    A row with fewer words, but not none, has one: its whole sequence.
    """
    counts = np.diff(first)
    spread = np.zeros(len(words) + width, np.uint64)
    spread[: len(words)] = words
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        total += mix(spread[k : k + len(words)] + _TURNS[k + 1])
    rows = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(np.maximum(counts - width + 1, 0)) - np.maximum(counts - width + 1, 0), np.maximum(counts - width + 1, 0))
    full = mix(total[first[rows] + place]) if len(rows) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    few = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        have = counts[short] > k
        few[have] += mix(words[first[short[have]] + k] + _TURNS[k + 1])
    few = mix(few + counts[short].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.concatenate([full, few]), np.concatenate([rows, short])


# ---------------------------------------------------------------- graphs


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): the smallest node of each node's component; nodes without edges are not listed.

    Large-star and small-star steps in turn, each linking neighbours to the smallest
    node in sight; every step is an aggregate and a join, so a node with very many
    edges is combined before the shuffle and split by skew handling.
    """
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    e = staged(e)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        e = staged(small.select("s.u", "s.v").where("u <> v").distinct())
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


# ---------------------------------------------------------------- letters

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters (a-z, Latin-1 capitals, other bytes from 0x80) of each row, every other run as one space.

    A row starts with a space where it has anything, so that a word's start shows.
    """
    low = LOWER[data]
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 0x20
    letter = _LETTER[low]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other bytes
    starts = offsets[:-1][np.diff(offsets) > 0]
    keep[starts] = letter[starts]
    low[~letter] = 0x20
    kept = np.concatenate([[0], np.cumsum(keep)])
    out, ends = low[keep], kept[offsets]
    lead = np.diff(ends) > 0
    spread = np.insert(out, ends[:-1][lead], 0x20)
    return spread, ends + np.concatenate([[0], np.cumsum(lead)])
