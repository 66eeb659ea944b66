"""Greedy packing of ordered pieces into chunks near a target length.

Only lengths are packed; texts join their chunk afterwards, in groups no longer
than one chunk.  The open chunk's length is the whole state of the packing, so a
long group is cut into spans: every span first works out where each possible
incoming length would lead, those answers are chained over the spans of a group,
and then each span packs its own pieces from its now known start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import SPACE, strip
from passagemill.options import PackRule
from passagemill.sources.sinks import scratch_dir


def hard_split(text: Column, size: int) -> Column:
    """Cut an oversized text at the last space in the final 40 % of ``size``, else at ``size``."""
    low = int(size * 0.6)
    part = rf"(?s)(?:.{{1,{size}}}\z|.{{{low},{size - 1}}}(?= )|.{{{size}}})"
    # Every part but the last is trimmed on both sides: white space after a cut
    # belongs to no part.
    found = F.regexp_extract_all(text, F.lit(f"({part}){SPACE}*"), F.lit(1))
    return F.transform(found, strip)


def split_pieces(pieces: DataFrame, rules: dict[str, PackRule]) -> DataFrame:
    """One row per part of each stripped, non-blank piece, with its type's target.

    ``part`` numbers a piece's parts; ``fresh`` marks the first part of a cut
    piece, which never joins the chunk before it when the whole piece would not.
    """
    body, kind = F.col("piece"), F.col("section_type")
    parts, target = F.array(body), F.lit(None).cast("int")
    for name, rule in rules.items():
        parts = F.when((kind == name) & (F.length(body) > rule.cap), hard_split(body, rule.cap)).otherwise(parts)
        target = F.when(kind == name, rule.target).otherwise(target)
    return (
        pieces.withColumn("piece", strip(body))
        .where(body != "")
        .select(
            *[c for c in pieces.columns if c != "piece"], target.alias("target"), parts.alias("_parts")
        )
        .select("*", F.posexplode_outer("_parts").alias("part", "piece"))
        .withColumn("fresh", (F.size("_parts") > 1) & (F.col("part") == 0))
        .drop("_parts")
    )


# Order of a part: its piece's position and its own number.  2**20 parts of at
# least 600 characters are more text than one row can hold.
PARTS_PER_PIECE = 1 << 20
INHERITED = -1


def _answers(sizes: Iterable[int], fresh: Iterable[bool], orders: Iterable[int], target: int):
    """Where every incoming length 0..target+1 leads (target+1 stands for anything longer).

    Returns the outgoing lengths and the orders of the parts that opened the
    outgoing chunks, ``INHERITED`` where that chunk was already open.
    """
    length = np.arange(target + 2)
    opened = np.full(target + 2, INHERITED, dtype=np.int64)
    place = np.arange(target + 2)
    for size, new, order in zip(sizes, fresh, orders):
        begins = (length == 0) | new | (length + size + 1 > target)
        length = np.minimum(np.where(begins, size, length + size + 1), target + 1)
        opened = np.where(begins, order, opened)
        # Different starts soon run together; from then on there is one state to follow.
        (opened, length), back = np.unique(np.stack([opened, length]), axis=1, return_inverse=True)
        place = back.reshape(-1)[place]
    return length[place], opened[place]


def _stream(rows: DataFrame, keys: list[str], group: list[str], out_ddl: str) -> DataFrame:
    """Pack sorted rows batch by batch; only the open chunk is held in memory.

    ``entry`` and ``start`` tell, on every row of a group, the length and name of
    the chunk that was open before the group.
    """
    columns = [*keys, "chunk_start", "order", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        length = start = first = 0
        pieces: list[str] = []
        done: list[tuple] = []

        def close() -> None:
            if pieces:
                done.append((*current[: len(keys)], start, first, "\n".join(pieces)))
                pieces.clear()

        for batch in batches:
            at = zip(*(batch[c].tolist() for c in group))
            state = zip(*(batch[c].tolist() for c in ("order", "size", "fresh", "target", "piece", "entry", "start")))
            for key, (order, size, fresh, target, piece, entry, open_start) in zip(at, state):
                if key != current:
                    close()
                    current, length, start = key, entry, open_start
                if length == 0 or fresh or length + size + 1 > target:
                    close()
                    start, length = order, size
                else:
                    length += size + 1
                if not pieces:
                    first = order
                pieces.append(piece)
            yield pd.DataFrame(done, columns=columns)
            done = []
        close()
        yield pd.DataFrame(done, columns=columns)

    return rows.repartition(*group).sortWithinPartitions(*group, "order").mapInPandas(run, out_ddl)


def pack(parts: DataFrame, keys: list[str], span: int | None) -> DataFrame:
    """Pack ``(keys, pos, part, piece, target, fresh)`` into ``(keys, chunk_start, text)``.

    A chunk is named by the order of its first part.  Without ``span`` every group
    is known to be small and one task packs it from end to end.
    """
    wide = parts.select(
        *keys,
        (F.col("pos") * PARTS_PER_PIECE + F.col("part")).alias("order"),
        *([] if span is None else [F.floor(F.col("pos") / span).cast("long").alias("_span")]),
        "target",
        "fresh",
        F.length("piece").alias("size"),
        "piece",
    )
    kinds = {f.name: f.dataType.simpleString() for f in wide.schema.fields}
    out_ddl = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", chunk_start long, order long, text string"
    if span is None:
        fresh_start = {"entry": F.lit(0), "start": F.lit(INHERITED).cast("long")}
        return _stream(wide.withColumns(fresh_start), keys, keys, out_ddl).drop("order")
    return _pack_in_spans(wide, keys, kinds, out_ddl)


def _pack_in_spans(wide: DataFrame, keys: list[str], kinds: dict[str, str], out_ddl: str) -> DataFrame:
    group = [*keys, "_span"]
    key_ddl = ", ".join(f"{k} {kinds[k]}" for k in group)
    # The pieces are read three times below; a table keeps that from redoing their making.
    table = scratch_dir(wide.sparkSession, "pieces")
    wide.write.parquet(table)
    wide = wide.sparkSession.read.parquet(table)
    narrow = wide.drop("piece")

    def answers(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order")
        state = (rows[c].tolist() for c in ("size", "fresh", "order"))
        length, opened = _answers(*state, int(rows["target"].iloc[0]))
        return pd.DataFrame([[*key, length.tolist(), opened.tolist()]], columns=[*group, "lengths", "opened"])

    def chain(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_span")
        length, start, entry = 0, INHERITED, []
        for lengths, opened in zip(rows["lengths"], rows["opened"]):
            entry.append((length, start))
            start = start if opened[length] == INHERITED else int(opened[length])
            length = int(lengths[length])
        out = pd.DataFrame(entry, columns=["entry", "start"])
        out["_span"] = rows["_span"].to_numpy()
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*group, "entry", "start"]]

    # Groups inside one span start empty; only the others need answers.
    long_groups = (
        narrow.groupBy(*keys)
        .agg(F.min("_span").alias("_lo"), F.max("_span").alias("_hi"))
        .where(F.col("_lo") < F.col("_hi"))
        .select(*keys)
    )
    entries = (
        narrow.join(long_groups, keys, "left_semi")
        .groupBy(*group)
        .applyInPandas(answers, f"{key_ddl}, lengths array<int>, opened array<long>")
        .groupBy(*keys)
        .applyInPandas(chain, f"{key_ddl}, entry int, start long")
    )
    known = wide.join(entries, group, "left").withColumns(
        {"entry": F.coalesce("entry", F.lit(0)), "start": F.coalesce("start", F.lit(INHERITED).cast("long"))}
    )
    # A chunk that crosses a span border arrives in two or more strips.
    strips = F.array_sort(F.collect_list(F.struct("order", "text")))
    return (
        _stream(known, keys, group, out_ddl)
        .groupBy(*keys, "chunk_start")
        .agg(strips.alias("strips"))
        .select(*keys, "chunk_start", F.array_join(F.transform("strips", lambda r: r["text"]), "\n").alias("text"))
    )
