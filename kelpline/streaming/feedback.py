"""Feedback kept up to date from a stream: the last event of each message wins, and when it was first seen is kept.

``dropDuplicatesWithinWatermark`` would keep the first. The table is a log of runs: each micro-batch writes its own
latest rows only, by bucket of the key, and every FAN runs of a level are merged into one of the next. Which runs are
live after a batch is the number of batches written in base FAN, so there is no list of files to keep, and a repeated
batch writes the same runs again. A row is rewritten once for each level, whatever the size of the table.

Null message ids are one key, as in ``operators.feedback.latest``. A batch without rows writes an empty run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kelpline.operators.feedback import latest

FAN, BUCKETS = 8, 16


def _merged(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key over runs, with the first of their ``first_seen``."""
    return latest(rows.drop("first_seen"), key, order, F.min("_first").alias("_least")).drop("first_seen").withColumnRenamed("_least", "first_seen")


def live(batch_id: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, last batch) of the runs that make the table after *batch_id*."""
    runs, count, level = [], batch_id + 1, 0
    end = count
    while count:
        for _ in range(count % fan):
            runs.append((level, end - 1))
            end -= fan**level
        count, level = count // fan, level + 1
    return runs[::-1]


def _merges(batch_id: int, fan: int) -> list[int]:
    """Levels whose last *fan* runs the batch merges."""
    levels = []
    while (batch_id + 1) % fan ** (len(levels) + 1) == 0:
        levels.append(len(levels))
    return levels


def _run(path: str, level: int, batch_id: int) -> str:
    return f"{path}/level={level}/batch={batch_id}"


def _read(spark: SparkSession, path: str, runs: list[tuple[int, int]], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*[_run(path, *r) for r in runs]).withColumn("_first", F.col("first_seen"))


def upsert(batch: DataFrame, batch_id: int, path: str, key: str = "message_id", order: str = "seq", fan: int = FAN) -> None:
    """Adds a micro-batch (message_id, seq, ...) to the table."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")
    own = latest(batch, key, order).select("*", bucket)
    write = lambda df, level: df.repartition(BUCKETS, "bucket").write.mode("overwrite").parquet(_run(path, level, batch_id))
    write(own, 0)
    for level in _merges(batch_id, fan):
        runs = [(level, batch_id - i * fan**level) for i in range(fan)]
        write(_merged(_read(spark, path, runs, own.schema), key, order).select(*own.columns), level + 1)
    # What the batch before merged is not needed any more, as that batch cannot come again.
    for level in _merges(batch_id - 1, fan) if batch_id else ():
        for i in range(fan):
            _delete(spark, _run(path, level, batch_id - 1 - i * fan**level))


def _delete(spark: SparkSession, place: str) -> None:
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def current(spark: SparkSession, path: str, batch_id: int, key: str = "message_id", order: str = "seq", fan: int = FAN) -> DataFrame:
    """The table after *batch_id*: the last row of each key and its ``first_seen``."""
    runs = live(batch_id, fan)
    schema = spark.read.parquet(_run(path, *runs[-1])).schema
    return _merged(_read(spark, path, runs, schema), key, order).drop("bucket")


def keep_latest(stream: DataFrame, path: str, checkpoint: str, fan: int = FAN) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(lambda batch, n: upsert(batch, n, path, fan=fan))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
