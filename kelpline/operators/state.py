"""Per-key state in batch form: sliding-window admission, history and last turns."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.session import cut, input_bytes, prepare

PART_BYTES = 64 << 20  # of requests that one task sorts


def restarts(requests: DataFrame, key: str, micros: str, order: str, window_us: int) -> DataFrame:
    """(key, micros, order, segment): a key's requests, cut wherever none came for a window. What was admitted before such a
    gap has left the window after it, so segments are decided apart. Runs at once: rows are stored in order.

    Requests are sorted by range, so one key may fill many tasks; a task knows all gaps but the one before its first row,
    which the first and last rows of all tasks tell.
    """
    spark = requests.sparkSession
    prepare(spark)
    slim = requests.select(key, micros, order)
    schema = slim.withColumns({"part": F.lit(0), "local": F.lit(0).cast("long")}).schema
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(slim) // PART_BYTES)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, local = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            made = []
            for now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                local += last is not None and _apart(last, now, window_us)
                made.append(local)
                last = now
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(made), pa.int32()), pa.array(made, pa.int64())], [*batch.schema.names, "part", "local"])

    placed = cut(slim.repartitionByRange(parts, key, micros, order).sortWithinPartitions(key, micros, order).mapInArrow(mark, schema))
    row = F.struct(F.col(key).alias("k"), F.col(micros).alias("t"))
    ends = placed.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"), F.max("local").alias("locals")).orderBy("part").collect()  # one row per task
    begins, number, last = [], -1, None
    for e in ends:
        number += last is None or _apart(last, tuple(e["first"]), window_us)
        begins.append((e.part, number))
        number, last = number + e.locals, tuple(e["last"])
    known = spark.createDataFrame(begins, "part int, begin long")
    return placed.join(F.broadcast(known), "part").select(key, micros, order, (F.col("begin") + F.col("local")).alias("segment"))  # one row per task


def _apart(last: tuple, now: tuple, window_us: int) -> bool:
    """Whether *now* (key, time) cannot meet *last* or anything before it in a window."""
    return last[0] != now[0] or last[1] is None or now[1] is None or now[1] - last[1] >= window_us


def admit(requests: DataFrame, key: str, micros: str, order: str, limit: int, window_us: int) -> DataFrame:
    """*requests* with ``admitted``: at most *limit* admitted requests of a key in any window; rejected ones do not count.

    A request at time t leaves the window at t + window. The decision depends on the earlier ones of the key since its last
    gap of a window or more, so each such segment is folded in order, holding *limit* times at most however many requests
    it has; the segments of one key run apart. A request without a time is admitted and counts nowhere. Runs at once.
    """
    rows = restarts(requests, key, micros, order, window_us)
    schema = rows.drop("segment").withColumn("admitted", F.lit(True)).schema
    dealt = rows.repartition("segment").sortWithinPartitions("segment", micros, order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, times = None, deque()
        for batch in batches:
            out = []
            for at, segment in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if segment != current:
                    current, times = segment, deque()
                while at is not None and times and at - times[0] >= window_us:
                    times.popleft()
                out.append(at is None or len(times) < limit)
                if out[-1] and at is not None:
                    times.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.bool_())], [*batch.schema.names[:3], "admitted"])

    return dealt.mapInArrow(fold, schema)


def history(messages: DataFrame, n: int = 8) -> DataFrame:
    """The last *n* messages of each conversation; messages without text are dropped after that cut."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("back", place).where((F.col("back") <= n) & F.col("text").isNotNull())


def last_user_turn(messages: DataFrame, chars: int = 80) -> DataFrame:
    """(conv_id, text): the beginning of the last message of role user."""
    users = messages.where(F.col("role") == "user")
    return users.groupBy("conv_id").agg(F.substring(F.max_by("text", "turn"), 1, chars).alias("text"))
