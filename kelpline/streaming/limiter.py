"""Sliding-window admission on a stream by event time: at most *limit* admitted requests of a key in any window.

A key's state holds the times of its admitted requests that a request the watermark still lets in could meet. When the
watermark has passed the last of them by a window, a timer clears the state, so idle keys cost nothing.

Late requests: those older than the watermark are dropped by Spark and get no decision. Others are judged when they
arrive, against all windows they fall into, including those of requests that came before but are later: decisions
already given stand, and no window ever holds more than *limit* admitted requests. Requests of one micro-batch are taken
in order of time, then of id; requests without a time get no decision. Needs the RocksDB state store.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fits(kept: list[int], at: int, limit: int, window_us: int) -> bool:
    """Whether one more at *at* leaves every window of the sorted times *kept* within *limit*."""
    first, last = bisect_right(kept, at - window_us), bisect_left(kept, at + window_us)
    near = sorted([*kept[first:last], at])
    return all(i + limit >= len(near) or near[i + limit] - near[i] >= window_us for i in range(len(near)))


class Admission(StatefulProcessor):
    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = sorted(t[0] for t in self.times.get()) if self.times.exists() else []
        batch = pd.concat(list(rows)).sort_values(["micros", "event_id"], kind="stable")
        admitted = []
        for at in batch["micros"].tolist():
            admitted.append(fits(kept, at, self.limit, self.window_us))
            if admitted[-1]:
                insort(kept, at)
        oldest = timerValues.getCurrentWatermarkInMs() * 1000 - self.window_us
        kept = [t for t in kept if t > oldest]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.times.put([(t,) for t in kept])
            self.handle.registerTimer((kept[-1] + self.window_us) // 1000 + 1)
        elif self.times.exists():
            self.times.clear()
        yield pd.DataFrame({"who": key[0], "event_id": batch["event_id"].to_numpy(), "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({"who": [], "event_id": [], "admitted": []}).astype({"who": "int64", "event_id": "int64", "admitted": "bool"})

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, limit: int, window_us: int, delay: str = "0 seconds") -> DataFrame:
    """(who, event_id, admitted) of a stream (who, micros, event_id), whose requests come up to *delay* late."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = requests.where(F.col("micros").isNotNull()).withColumn("at", F.timestamp_micros("micros")).withWatermark("at", delay)
    return timed.groupBy("who").transformWithStateInPandas(
        statefulProcessor=Admission(limit, window_us), outputStructType="who long, event_id long, admitted boolean", outputMode="Append", timeMode="EventTime"
    )
