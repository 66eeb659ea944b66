"""Live folding of chat events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from passagemill.operators.conversations import ANSWER, CANCEL, COMPLETE, REASONING, RETRIEVE
from passagemill.schemas import CHAT_EVENT

FOLDED = (
    "conversation_id string, turn_id long, context string, reasoning string, answer string, "
    "status string, input_tokens_used int, output_tokens_used int"
)
Turn = Row(*(column.split()[0] for column in FOLDED.split(", ")))
# What is known of an open turn: all numbers below ``upto`` came, of the later ones those in
# ``beyond``; the closing event, if it came; when the turn is given up.
OPEN = "upto long, beyond array<long>, last long, status string, tokens_in int, tokens_out int, timer long"
PART = "seq long, kind string, text string"
# Events of one turn as one row, a list for each field.
PACKED = (
    "conversation_id string, turn_id long, seq array<long>, type array<string>, content array<string>, "
    "status array<string>, tokens_in array<int>, tokens_out array<int>"
)
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Newline-delimited JSON events from a growing folder."""
    return (
        spark.readStream.schema(CHAT_EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


class Event(NamedTuple):
    """What the fold reads of an event, in the order of the lists of ``PACKED``."""

    seq: int
    type: str
    content: str
    status: str
    tokens_in: int
    tokens_out: int


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events ``(conversation_id, turn_id, *Event)`` of each batch as one row a turn, in their order of arrival."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.take(pc.sort_indices(batch, [("conversation_id", "ascending"), ("turn_id", "ascending")]))  # a stable sort
        ends = [pc.run_end_encode(rows.column(i)).run_ends.to_numpy() for i in range(2)]  # a null is a key too
        last = np.union1d(*ends).astype(np.int32)
        keys = rows.select([0, 1]).take(pa.array(last - 1))
        offsets = pa.array(np.concatenate([[0], last]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, rows.column(i)) for i in range(2, rows.num_columns)]
        yield pa.RecordBatch.from_arrays([*keys.columns, *lists], names=rows.schema.names)


class TurnFold(StatefulProcessor):
    """Events of a turn are appended to a list; a small value beside it tells when the turn is whole."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.parts = handle.getListState("parts", PART)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.open.get()
        upto, beyond, last, status, tokens_in, tokens_out, timer = held or (0, [], -1, "", 0, 0, None)
        ahead, fresh = set(beyond), []
        for r in rows:
            if r.seq < upto or r.seq in ahead:  # delivered again
                continue
            ahead.add(r.seq)
            fresh.append((r.seq, r.type, r.content))
            if r.status in (COMPLETE, CANCEL):
                last, status, tokens_in, tokens_out = r.seq, r.status, r.tokens_in, r.tokens_out
            while upto in ahead:
                ahead.remove(upto)
                upto += 1
        # The closing event's number tells how many came before it, so events that
        # arrive out of order are waited for; what is numbered after it does not count.
        if last >= 0 and upto > last:
            parts = sorted(p for p in [*fresh, *(self.parts.get() if held else [])] if p[0] <= last)
            if held:
                self._drop(timer)
            context = [text for _, kind, text in parts if kind == RETRIEVE]
            reasoning, answer = ("".join(text for _, kind, text in parts if kind == k) for k in (REASONING, ANSWER))
            yield Turn(*key, context[-1] if context else "", reasoning, answer, status, tokens_in, tokens_out)
        elif fresh:
            self.parts.appendList(fresh)
            if self.idle_ms is not None:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
                self.handle.registerTimer(timer)
            self.open.update((upto, sorted(ahead), last, status, tokens_in, tokens_out, timer))

    def _drop(self, timer: int | None) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.open.clear()
        self.parts.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._drop(None)
        return iter(())


class PackedTurnFold(TurnFold):
    """The fold of rows that hold several events of a turn."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = (event for r in rows for event in map(Event, *r[2:]))
        return super().handleInputRows(key, events, timerValues)


def fold_event_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """One row per turn as soon as all its events are there; its state is then dropped.

    A turn whose events come in one micro-batch never enters the state store.  For any other
    an event is appended, not rewritten; only the numbers that came out of order are kept
    beside it.  The events carry no time, so state is bounded by the number of open turns
    rather than by a watermark.  An event delivered again is ignored by its number, one
    numbered after the closing event does not count.  What arrives for a turn that was
    already given out is not emitted again.  A query that runs on sets ``idle_ms``: a timer
    drops such state, like that of a turn which never closes, after so long without events.
    (With timers a query always plans one more batch, so a run that stops at the end of its
    input has none.)

    The stateful step makes a Python row of every input row, cell by cell, so the events of a
    turn are packed into one row for each Arrow batch before; none is joined with another or left out.
    """
    flat = events.selectExpr(
        "conversation_id",
        "turn_id",
        "seq",
        "type",
        "content",
        "status",
        "coalesce(metadata.input_tokens_used, 0) as tokens_in",
        "coalesce(metadata.output_tokens_used, 0) as tokens_out",
    )
    mode = "None" if idle_ms is None else "ProcessingTime"
    turns = flat.mapInArrow(packed, PACKED).groupBy("conversation_id", "turn_id")
    return turns.transformWithState(PackedTurnFold(idle_ms), FOLDED, "Append", mode)


def run_to_table(folded: DataFrame, target: str, checkpoint: str) -> None:
    """Process everything available, append to a Parquet table, stop.

    List state and timers need the RocksDB store; a query keeps the store that the session
    names when it starts, so the session's own setting is put back at once.
    """
    conf = folded.sparkSession.conf
    own = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ROCKSDB)
    try:
        query = (
            folded.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(target)
        )
    finally:
        conf.set(STATE_STORE, own) if own else conf.unset(STATE_STORE)
    query.awaitTermination()
