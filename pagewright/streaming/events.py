"""Event streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that expiring state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Cap(StatefulProcessor):
    """Counts a key's events and when the last one was; both go when the key has been silent for long enough."""

    def __init__(self, time: str, most: int, silence_ms: int):
        self.time, self.most, self.silence = time, most, silence_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n int, last long")

    def handleInputRows(self, key, rows, timerValues):
        n, last = self.seen.get() if self.seen.exists() else (0, 0)
        out = []
        for batch in rows:
            batch = batch.sort_values(self.time, kind="stable")
            out.append(batch.iloc[: max(0, self.most - n)])
            n += len(batch)
            last = max(last, int(batch[self.time].max().value // 1_000_000))
        self.seen.update((min(n, self.most), last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.silence)
        if out:
            yield pd.concat(out, ignore_index=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def capped(events: DataFrame, by: str, time: str, most: int = 400, late: str = "10 minutes", silence: str = "1 day") -> DataFrame:
    """The first `most` events of each key of a stream, in the order of their arrival, by time within a batch.

    by: the key; time: a timestamp, by which events may be late by `late`. The state of a key is a count, which expires by event time once the watermark has
    passed its last event by `silence`; events after that count anew. So state follows the keys that are active, not all that ever were. Needs the state store STORE.
    """
    silence_ms = int(events.sparkSession.range(1).select((F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"INTERVAL {silence}"))).alias("ms")).first()[0])
    stream = events.withWatermark(time, late).groupBy(by)
    return stream.transformWithStateInPandas(_Cap(time, most, silence_ms), outputStructType=events.schema, outputMode="Append", timeMode="EventTime")
