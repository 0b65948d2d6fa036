"""A sliding-minute limiter as a stream: a queue of admissions for each key, with timers that forget it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.limits import MINUTE, micros

RESULT = "event_id long, start_us long, waited_us long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """Admits a key's requests, rpm and tpm of any minute at most, in the order they come in; rows of one
    micro-batch by time and event. A request over tpm alone goes once nothing else is in the minute."""

    def __init__(self, rpm: int, tpm: float):
        self.rpm, self.tpm = rpm, tpm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # each call goes to the JVM and back, so a key has one state: its clock, its pending timer, a minute's
        # admissions (rpm at most, or one)
        self.held = handle.getValueState("held", "now long, timer long, starts array<long>, costs array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, timer, starts, costs = self.held.get() or (0, 0, [], [])
        recent = deque(zip(starts, costs, strict=True))
        parts = [tuple(part[c].to_numpy() for c in ("event_id", "us", "value")) for part in rows]
        event, us, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort([event, us])
        used, began = sum(costs), []
        for at, cost in zip(us[order].tolist(), np.nan_to_num(value[order].astype(np.float64)).tolist(), strict=True):
            now = max(now, at)
            while True:
                while recent and now - recent[0][0] >= MINUTE:
                    used -= recent.popleft()[1]
                if not recent or (len(recent) < self.rpm and used + cost <= self.tpm):
                    break
                now = recent[0][0] + MINUTE
            recent.append((now, cost))
            used += cost
            began.append(now)
        if not timer:
            timer = self._due(now)
            self.handle.registerTimer(timer)
        self.held.update((now, timer, [t for t, _ in recent], [c for _, c in recent]))
        start = np.array(began, np.int64)
        yield pd.DataFrame({"event_id": event[order], "start_us": start, "waited_us": start - us[order]})

    @staticmethod
    def _due(now: int) -> int:
        """Once the watermark is a minute past the last admission, nothing of it counts any more."""
        return (now + MINUTE) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, timer, starts, costs = self.held.get() or (0, 0, [], [])
        if self._due(now) > timer:  # there were admissions since it was set
            self.handle.registerTimer(self._due(now))
            self.held.update((now, self._due(now), starts, costs))
        else:
            self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited(events: DataFrame, rpm: int, tpm: float, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """(event_id, start_us, waited_us) of a stream of events: when each would start. State of a key goes
    once the watermark is a minute past its last admission. Needs the RocksDB state store."""
    events.sparkSession.conf.set(STORE, ROCKS)
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = rows.select("event_id", F.col(key).alias("key"), micros("ts").alias("us"), F.col("value").cast("double").alias("value"), "at")
    return rows.groupBy("key").transformWithStateInPandas(Limiter(rpm, tpm), outputStructType=RESULT, outputMode="append", timeMode="eventTime")
