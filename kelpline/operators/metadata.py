"""Metadata joins, coverage, identifiers and content fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions import text as tx
from kelpline.session import Scratch, input_bytes

PART_BYTES = 64 << 20  # of rows that one task sorts


def with_metadata(docs: DataFrame, meta: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join to one row per key of *meta*; Spark picks the strategy from the sizes it measures."""
    joined = docs.join(meta, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def by_title(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """Full texts with the metadata of their normalised title, or its defaults."""
    keyed = docs.withColumn("title_norm", tx.title_key(F.col("title")))
    return with_metadata(keyed, meta, "title_norm", {"url": "", "category": "法規", "type": "regulation", "date": ""})


def unmatched(docs: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    return docs.join(meta.select(key), key, "left_anti")


def dense_ids(rows: DataFrame, order: list[str], name: str = "doc_id") -> DataFrame:
    """*rows* with *name* 0, 1, ... in *order*: partitions are numbered by offsets of their counts, without one global sort task.
    Runs at once: rows are stored, then stored in order. The size that counts is that of the stored rows, as the planner takes a
    join for the product of both sides, and sampling for the ranges does not compute the rows again."""
    scratch = Scratch(rows.sparkSession)
    scratch.drop_at_exit()
    rows = scratch.cut(rows)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(rows) // PART_BYTES)
    placed = scratch.cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()))
    scratch.remove(scratch.count - 1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # one row per partition
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_mono") - F.col("_first")).drop("_part", "_mono", "_first", "_offset")


def fingerprint(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(fingerprint): one digest of all contents. Each part is digested without regard to row order: by its count
    and the sums of both halves of each text's MD5; the parts' digests are joined in the order of their names."""
    digest = F.md5(F.encode(F.coalesce(text, F.lit("")), "utf-8"))
    half = lambda start: F.sum(F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)")).cast("string")
    parts = docs.groupBy(by).agg(F.md5(F.encode(F.concat_ws(":", F.count(F.lit(1)).cast("string"), half(1), half(17)), "utf-8")).alias("digest"))
    line = F.concat_ws(":", F.coalesce(by, F.lit("")), "digest")
    whole = F.array_join(F.array_sort(F.collect_list(line)), "|")  # one line per part
    return parts.agg(F.md5(F.encode(whole, "utf-8")).alias("fingerprint"))
