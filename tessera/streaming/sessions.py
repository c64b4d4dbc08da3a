"""Streams of deltas that end: chunks are kept as state only until their stream is whole or given up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Deltas with an end mark: the row whose ``last`` is true has the highest ``seq`` of its stream, its chunk may be null.
ENDED_DELTA = "stream_id string, seq bigint, chunk string, last boolean, sent_at timestamp"
WHOLE = "stream_id string, content string, chunks bigint, ended boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Joiner(StatefulProcessor):
    """One stream's chunks by number, its last number once that is known, and its timer."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "seq bigint", "chunk string")
        self.progress = handle.getValueState("progress", "held bigint, last bigint, done boolean, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # such rows only move the watermark
            for _ in rows:
                pass
            return
        held, last, done, timer = self.progress.get() if self.progress.exists() else (0, None, False, None)
        newest = 0
        for batch in rows:
            newest = max([newest, *(int(t.timestamp() * 1000) for t in batch["sent_at"])])
            for seq, chunk, end in zip(batch["seq"], batch["chunk"], batch["last"]):
                if done or pd.isna(seq):
                    continue
                if end is not None and not pd.isna(end) and end:
                    last = int(seq) if last is None else max(last, int(seq))
                if not self.chunks.containsKey((int(seq),)):
                    self.chunks.updateValue((int(seq),), (None if pd.isna(chunk) else chunk,))
                    held += 1
        due = newest + self.idle_ms
        if timer is None or due > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        if not done and last is not None and held == last + 1:
            yield self._content(key[0], held, True)
            self.chunks.clear()
            held, done = 0, True
        self.progress.update((held, last, done, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _, done, _ = self.progress.get() if self.progress.exists() else (0, None, True, None)
        if not done:
            yield self._content(key[0], held, False)
        self.chunks.clear()
        self.progress.clear()

    def close(self) -> None:
        pass

    def _content(self, name: str, held: int, ended: bool) -> pd.DataFrame:
        parts = sorted(((k[0], v[0]) for k, v in self.chunks.iterator()), key=lambda x: x[0])
        return pd.DataFrame({"stream_id": [name], "content": ["".join(c for _, c in parts if c is not None)], "chunks": [held], "ended": [ended]})


def joined(deltas: DataFrame, late: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """One row (stream_id, content, chunks, ended) for each stream, in append mode, as soon as its chunks 0 to the marked last one are
    all there, whatever order they came in. A stream that stays silent for ``idle_ms`` of event time is given up: the chunks that it has are
    its content and ``ended`` is false.

    The first chunk of a number counts; repeated ones and those that follow a whole stream are dropped. All of a stream's state goes
    with its timer: the chunks when it is whole, the note that it was when it has been silent. Rows later than the
    watermark (``late``) are dropped by Spark. A null chunk counts and is empty; rows without a number are left out; those without a stream move the watermark
    only. ``sent_at`` must not be null. Needs the RocksDB state store (STATE_STORE) in spark.sql.streaming.stateStore.providerClass.
    The chunks of one stream must fit a worker, as its content is one row."""
    rows = deltas.select("stream_id", "seq", "chunk", "last", "sent_at").withWatermark("sent_at", late)
    return rows.groupBy("stream_id").transformWithStateInPandas(Joiner(idle_ms), WHOLE, "append", "eventTime")
