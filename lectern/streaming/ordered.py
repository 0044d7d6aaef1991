"""Transcripts of a session in the order they were spoken, each once, from any delivery.

The state is Spark's: a map of waiting rows and the last place released, per session, in RocksDB
with the query's checkpoint. Event-time timers release rows when the watermark has passed them
and drop the session after a quiet time, so nothing is kept for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "seq long, ts timestamp, text string, is_final boolean"
WAITING = "ms long, text string, is_final boolean"
QUIET_MS = 3_600_000


class InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them; releases them by ``seq``, each once.

    A row whose place has been released is a repeat, or too late, and is dropped.
    """

    def __init__(self, key: T.StructField, quiet_ms: int) -> None:
        self.key, self.quiet_ms = key, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", WAITING)
        self.last = handle.getValueState("last", "seq long, newest long")

    def _progress(self) -> tuple[int | None, int]:
        return self.last.get() if self.last.exists() else (None, 0)

    def _later(self, at: int) -> None:
        """Exactly one timer stands for a session."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _due(self, newest: int, watermark: int) -> None:
        first = min((int(v[0]) for _, v in self.waiting.iterator()), default=newest + self.quiet_ms)
        self._later(max(first, watermark + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, newest = self._progress()
        for batch in rows:
            for seq, ms, text, final in zip(batch["seq"], batch["ms"], batch["text"], batch["is_final"]):
                newest = max(newest, int(ms))
                if (done is None or seq > done) and not self.waiting.containsKey((int(seq),)):
                    self.waiting.updateValue((int(seq),), (int(ms), text, bool(final)))
        self.last.update((done, newest))
        self._due(newest, timerValues.getCurrentWatermarkInMs())
        yield self._frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        done, newest = self._progress()
        held = sorted((int(k[0]), v) for k, v in self.waiting.iterator())
        # a row is ready once all that were spoken up to its time have had their chance to arrive
        ready = [(seq, v) for seq, v in held if int(v[0]) <= watermark]
        last = max((seq for seq, _ in ready), default=None)
        out = [(seq, v) for seq, v in held if last is not None and seq <= last]
        for seq, _ in out:
            self.waiting.removeKey((seq,))
        if len(out) == len(held) and newest + self.quiet_ms <= watermark:
            self.waiting.clear()
            self.last.clear()
        else:
            done = last if last is not None else done
            self.last.update((done, newest))
            self._due(newest, watermark)
        yield self._frame(key, out)

    def _frame(self, key, rows) -> pd.DataFrame:
        return pd.DataFrame(
            {
                self.key.name: pd.Series([key[0]] * len(rows), dtype=object if isinstance(self.key.dataType, T.StringType) else "int64"),
                "seq": pd.Series([s for s, _ in rows], dtype="int64"),
                "ms": pd.Series([int(v[0]) for _, v in rows], dtype="int64"),
                "text": pd.Series([v[1] for _, v in rows], dtype=object),
                "is_final": pd.Series([bool(v[2]) for _, v in rows], dtype=bool),
            }
        )

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, delay: str = "10 minutes", key: str = "session", quiet_ms: int = QUIET_MS) -> DataFrame:
    """(key, seq, ts, text, is_final), each (key, seq) once and in order within its key.

    A row that comes again, or later than ``delay`` behind the newest, changes nothing. Needs the
    RocksDB state store (``use_rocksdb``).
    """
    field = stream.schema[key]
    rows = stream.withWatermark("ts", delay).select(key, "seq", "ts", F.unix_millis("ts").alias("ms"), "text", "is_final")
    schema = T.StructType([field, *T._parse_datatype_string("seq long, ms long, text string, is_final boolean").fields])
    out = rows.groupBy(key).transformWithStateInPandas(InOrder(field, quiet_ms), schema, "Append", "EventTime")
    return out.select(key, "seq", F.timestamp_millis("ms").alias("ts"), "text", "is_final")


def use_rocksdb(spark) -> None:
    """Keep streaming state in RocksDB from the next query on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
