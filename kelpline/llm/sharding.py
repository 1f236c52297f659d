"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-sorted by a digest of their text and by id, so that equal texts lie side by side. Each sorted
partition adds up its sizes; the per-partition totals, summed in order, give every row its global offset. The
total is cut at equal targets, each cut falling on a row boundary. Where a cut would split a group of equal
texts that is small against a shard (``snap``), it moves to the nearer end of that group; larger groups are split.

Defined cases: a null text has no bytes, so its size is 1; ties and repeated rows keep separate slots (their
order among themselves is free); a null id sorts first; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kelpline.llm import workers
from kelpline.session import cut, prepare


@workers.task
def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the bytes and rows of this partition before each row."""
    size_before = rows_before = 0
    for batch in batches:
        sums = pc.cumulative_sum(batch.column("size"))
        starts = pc.add(pc.subtract(sums, batch.column("size")), size_before)
        places = pa.array(range(rows_before, rows_before + batch.num_rows), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, starts, places], [*batch.schema.names, "start_in_part", "row_in_part"])
        size_before += pc.sum(batch.column("size")).as_py() or 0
        rows_before += batch.num_rows


def with_offsets(rows: DataFrame, order: list[str]) -> DataFrame:
    """*rows* (with a long ``size``) with the bytes and rows before each in the global order of *order*."""
    prepare(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = StructType([*ordered.schema, StructField("start_in_part", LongType()), StructField("row_in_part", LongType())])
    placed = cut(ordered.mapInArrow(_running, schema))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    offsets = totals.select(  # one row per partition
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_offset"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row_offset"),
    )
    return placed.join(F.broadcast(offsets), "part").select(
        *rows.columns,
        (F.col("size_offset") + F.col("start_in_part")).alias("start"),
        (F.col("row_offset") + F.col("row_in_part")).alias("row_no"),
    )


def shard_by_bytes(docs: DataFrame, shards: int = 8, snap: float = 0.02, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row; ``slot`` counts from 0 in each shard.

    ``snap`` is the share of a shard's target by which a cut may move to keep equal texts together.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"),
        (F.octet_length(whole) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(whole, "utf-8")).alias("crc"),
        F.xxhash64(whole).alias("digest"),
    )
    placed = with_offsets(cut(rows), ["crc", "digest", "id"])  # stored, so that texts are read once
    total = placed.agg(F.sum("size")).first()[0] or 0
    target = total / shards
    wanted = [total * k // shards for k in range(1, shards)]
    # The rows that the cuts meet, and the groups they belong to: at most one for each cut.
    goals = docs.sparkSession.createDataFrame([(g,) for g in wanted], "goal long")
    met = placed.join(F.broadcast(goals), (F.col("start") <= F.col("goal")) & (F.col("goal") < F.col("start") + F.col("size")))
    edges = met.select("goal", "crc", "digest", F.col("start").alias("row_start"), (F.col("start") + F.col("size")).alias("row_end"))
    groups = (
        placed.join(F.broadcast(edges), ["crc", "digest"])
        .groupBy("goal", "row_start", "row_end")
        .agg(F.min("start").alias("group_start"), F.max(F.col("start") + F.col("size")).alias("group_end"))
        .collect()
    )
    cuts = []
    for g in groups:
        ends = [g.group_start, g.group_end]
        near = min(ends, key=lambda e: abs(e - g.goal))
        if abs(near - g.goal) > snap * target:
            near = min([g.row_start, g.row_end], key=lambda e: abs(e - g.goal))
        cuts.append(near)
    shard = sum((F.when(F.col("start") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    cast = placed.withColumn("shard", shard)
    firsts = cast.groupBy("shard").agg(F.min("row_no").alias("first_row"))  # one row per shard
    return cast.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row_no") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
