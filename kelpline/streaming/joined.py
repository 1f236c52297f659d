"""Answers and feedback joined as two streams, by message and event time.

Both streams meet in one stateful operator, which keeps the last answer and the last feedback of each message, whichever
comes first. When no event of a message has come for *settle* of event time, a timer hands its row on: rated and
answered, rated only (an orphan), or answered only. The settled rows are what the batch joins of the whole logs give.

Events older than the watermark are dropped by Spark. A message that gets events after it was settled makes another
row. Events without a message id or a time take no part: without an id they could never settle apart. Of events of a
kind with equal ``seq`` the one that comes last in its micro-batch wins. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kelpline.streaming.limiter import STATE_STORE

SETTLED = "message_id string, rating string, feedback_seq long, first_seen long, dept string, answer_seq long"
NAMES = [c.split()[0] for c in SETTLED.split(", ")]


class Meeting(StatefulProcessor):
    def __init__(self, settle_ms: int):
        self.settle_ms = settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.feedback = handle.getValueState("feedback", "seq bigint, rating string, first_seen bigint")
        self.answer = handle.getValueState("answer", "seq bigint, dept string")
        self.latest = handle.getValueState("latest", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        batch = batch.astype(object).where(batch.notna(), None)
        for kind, own in batch.groupby("kind"):
            last = own.iloc[-1]
            if kind == "answer":
                held = self.answer.get() if self.answer.exists() else None
                if held is None or int(last["seq"]) >= held[0]:
                    self.answer.update((int(last["seq"]), last["what"]))
            else:
                held, first = (self.feedback.get() if self.feedback.exists() else None), int(own["seq"].iloc[0])
                newer = held is None or int(last["seq"]) >= held[0]
                told = (int(last["seq"]), last["what"]) if newer else (held[0], held[1])
                self.feedback.update((*told, first if held is None else min(first, held[2])))
        latest = max(int(pd.Timestamp(t).timestamp() * 1000) for t in batch["at"])
        if self.latest.exists():
            latest = max(latest, self.latest.get()[0])
        self.latest.update((latest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(latest + self.settle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({n: pd.Series(dtype="object" if n in ("message_id", "rating", "dept") else "Int64") for n in NAMES})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, rating, first = self.feedback.get() if self.feedback.exists() else (None, None, None)
        answer_seq, dept = self.answer.get() if self.answer.exists() else (None, None)
        for state in (self.feedback, self.answer, self.latest):
            if state.exists():
                state.clear()
        made = pd.DataFrame([(key[0], rating, seq, first, dept, answer_seq)], columns=NAMES)
        yield made.astype({n: "Int64" for n in ("feedback_seq", "first_seen", "answer_seq")})

    def close(self) -> None:
        pass


def settle(answers: DataFrame, feedback: DataFrame, delay: str, settle_ms: int) -> DataFrame:
    """(message_id, rating, feedback_seq, first_seen, dept, answer_seq) of each message once it is settled. *answers* are
    (message_id, seq, at, dept), *feedback* (message_id, seq, at, rating); events come up to *delay* late. A null
    ``feedback_seq`` is an answer without feedback, a null ``answer_seq`` an orphan."""
    answers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kinds = [(answers, "answer", "dept"), (feedback, "feedback", "rating")]
    both = [rows.select("message_id", "seq", "at", F.lit(kind).alias("kind"), F.col(what).alias("what")) for rows, kind, what in kinds]
    events = both[0].unionByName(both[1]).where(F.col("message_id").isNotNull() & F.col("at").isNotNull()).withWatermark("at", delay)
    return events.groupBy("message_id").transformWithStateInPandas(statefulProcessor=Meeting(settle_ms), outputStructType=SETTLED, outputMode="Append", timeMode="EventTime")
