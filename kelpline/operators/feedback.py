"""Feedback analytics: last-write-wins, rates, cases, orphans, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions import text as tx
from kelpline.session import cut, input_bytes

PART_BYTES = 64 << 20  # of values that one task sorts

#: Reasons that a rating may carry.
REASONS = ("wrong_info", "outdated", "off_topic", "too_vague", "bad_source", "other")


def valid_feedback(events: DataFrame, reasons: tuple[str, ...] = REASONS, id_length: int = 64, comment_length: int = 500) -> DataFrame:
    """Accepted feedback in its stored form: rating up or down, id and comment cut, known reasons once in order."""
    rating = F.lower(tx.strip(F.coalesce("rating", F.lit(""))))
    ident = F.substring(tx.strip(F.coalesce("message_id", F.lit(""))), 1, id_length)
    return (
        events.withColumn("rating", rating)
        .withColumn("message_id", ident)
        .where(F.col("rating").isin("up", "down") & (F.col("message_id") != ""))
        .withColumn("reasons", F.array_intersect(F.coalesce("reasons", F.array().cast("array<string>")), F.array(*map(F.lit, reasons))))
        .withColumn("comment", F.substring(tx.strip(F.coalesce("comment", F.lit(""))), 1, comment_length))
    )


def latest(rows: DataFrame, key: str, order: str, *more: Column) -> DataFrame:
    """The last row of each key by *order*, with ``first_seen``, the order of its first; null keys are one key."""
    payload = F.struct(*[c for c in rows.columns if c != key])
    last = rows.groupBy(key).agg(F.max_by(payload, order).alias("_last"), F.min(order).alias("first_seen"), *more)
    return last.select(key, "_last.*", "first_seen", *[c for c in last.columns if c not in (key, "_last", "first_seen")])


def rates(feedback: DataFrame) -> DataFrame:
    """(up, down, total, satisfaction): other ratings count in neither."""
    up, down = F.count_if(F.col("rating") == "up"), F.count_if(F.col("rating") == "down")
    return feedback.agg(up.alias("up"), down.alias("down")).withColumn("total", F.col("up") + F.col("down")).withColumn("satisfaction", F.round(F.try_divide("up", "total"), 6))


def rates_by(feedback: DataFrame, answers: DataFrame, by: str) -> DataFrame:
    """Ratings by a column of the answer they meet; here whatever is not ``up`` counts as down."""
    met = feedback.join(answers.select("message_id", by), "message_id")
    counted = met.groupBy(by).agg(F.count_if(F.coalesce(F.col("rating") == "up", F.lit(False))).alias("up"), F.count(F.lit(1)).alias("total"))
    return counted.select(by, "up", (F.col("total") - F.col("up")).alias("down"), "total", F.round(F.try_divide("up", "total"), 6).alias("satisfaction")).orderBy(F.desc("total"), by)


def orphans(feedback: DataFrame, answers: DataFrame) -> DataFrame:
    return feedback.join(answers.select("message_id"), "message_id", "left_anti")


def negative_cases(feedback: DataFrame, answers: DataFrame, n: int = 10) -> DataFrame:
    """The last *n* down-rated messages by first appearance, with what is known of their answers."""
    cases = feedback.where(F.col("rating") == "down").orderBy(F.desc("first_seen")).limit(n)
    return cases.join(F.broadcast(cases.select("message_id")).join(answers, "message_id"), "message_id", "left")


def nearest_rank(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, p50, p95, max) where p50 is element n//2 and p95 element max(0, int(0.95 n) - 1) in rising order.

    *by* may be empty: one group of all rows. Values are counted and range-sorted, so that a group is ranked over
    as many partitions as it fills: counts of a partition's groups, summed in order, tell how many rows lie before it.
    Runs at once: the counts are stored in order.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(rows) // PART_BYTES)
    keys = [f"_by_{i}" for i in range(len(by))]
    held = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("_value"))
    steps = held.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_times"))  # equal values are one row
    placed = cut(steps.repartitionByRange(parts, *keys, "_value").withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part", *keys).agg(F.sum("_times").alias("_own"))
    group = Window.partitionBy(*keys).orderBy("_part")  # a row for each partition
    sums = sums.select(F.col("_part").alias("_at"), *[F.col(k).alias(f"{k}_at") for k in keys], (F.sum("_own").over(group) - F.col("_own")).alias("_before"), F.sum("_own").over(Window.partitionBy(*keys)).alias("n"))
    same = (F.col("_part") == F.col("_at"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_at"))
    inside = F.sum("_times").over(Window.partitionBy("_part", *keys).orderBy("_value"))
    ends = placed.withColumn("_inside", inside).join(sums, same).withColumn("_upto", F.col("_before") + F.col("_inside"))
    n = F.col("n")
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_value")))
    middle, high = F.floor(n / 2), F.greatest(F.lit(0), F.floor(n * 95 / 100).cast("long") - 1)
    found = ends.groupBy(*keys, "n").agg(at(middle).alias("p50"), at(high).alias("p95"), F.max("_value").alias("max"))
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", "p50", "p95", "max")


def usage(answers: DataFrame, by: str) -> DataFrame:
    """(by, answers, sessions, first_seen): counts by falling size, ties by first appearance; blank sessions do not count."""
    counted = answers.groupBy(by).agg(F.count(F.lit(1)).alias("answers"), F.count_distinct(F.nullif(F.col("session_id").cast("string"), F.lit(""))).alias("sessions"), F.min("seq").alias("first_seen"))
    return counted.orderBy(F.desc("answers"), "first_seen")


def reason_counts(feedback: DataFrame) -> DataFrame:
    return feedback.select("first_seen", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("first_seen").alias("seen")).orderBy(F.desc("n"), "seen")
