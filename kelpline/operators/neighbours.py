"""Exact nearest neighbours by squared L2 that skip far shards.

Some rows, the least by a hash, are pivots; every row belongs to its nearest pivot, and a pivot's rows are a shard with
the least and the greatest distance from it, cut into pieces where it is large. By the triangle inequality a shard
lies at least as far from a query as its ring around the pivot does. Each query first meets the shards nearest by that
bound until they hold k rows; the k-th distance found is its reach, and of the other shards only those whose bound is
within it are compared. Queries and pieces meet in blocks; each task keeps k for each query.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors of different
length are not compared; with keys, only rows of equal, non-null keys are. Rows of a repeated id are ranked each. Ranks go by
distances of ten decimals, then by id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.session import Scratch, prepare

SHARD_ROWS, BLOCK = 8192, 4096
PAIRS = 1 << 16  # whose differences are held at a time
MOST_PIVOTS = 512  # every task holds them
FOUND = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("distance", pa.float64())])


def _vectors(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = rows.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of *x* from all of the few rows *y*, from differences: nothing cancels for near pairs."""
    return np.sqrt(np.stack([((x - one) ** 2).sum(1) for one in y], axis=1))


def _near(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k nearest of the rows *left* for each query of *right*."""
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        ids, x = left.column("doc_id").to_numpy(), _vectors(left)
        asks, y = right.column("query_id").to_numpy(), _vectors(right)
        long = (x * x).sum(1)
        made = []
        for a in range(0, len(y), 256):
            some = y[a : a + 256]
            far = long[None] - 2 * some @ x.T  # squared distances but for a constant: what may be among the k nearest
            last = np.partition(far, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            slack = 1e-9 + 1e-9 * (long.max() + (some * some).sum(1))
            i, j = np.nonzero(far <= (last + slack)[:, None])
            parts = [slice(p, p + PAIRS) for p in range(0, len(i), PAIRS)]  # among equal vectors all pairs may be near
            apart = np.concatenate([np.zeros(0), *(((x[j[p]] - some[i[p]]) ** 2).sum(1) for p in parts)]).round(10)
            order = np.lexsort((ids[j], apart, i))
            i, j, apart = i[order], j[order], apart[order]
            near = np.arange(len(i)) - np.searchsorted(i, i) < k
            made.append(pa.table([pa.array(asks[a + i[near]]), pa.array(ids[j[near]]), pa.array(apart[near])], schema=FOUND))
        return pa.concat_tables(made)

    return search


def nearest(queries: DataFrame, corpus: DataFrame, k: int, keys: Sequence[str] = (), shard_rows: int = SHARD_ROWS, block: int = BLOCK, read: dict | None = None) -> DataFrame:
    """(query_id, rank, doc_id, distance): the k nearest rows of *corpus* (doc_id, vector, *keys) for each of *queries* (query_id,
    vector, *keys). *read* is told how many rows the queries could be compared with and how many they were. Runs at once."""
    spark = corpus.sparkSession
    prepare(spark)
    v = F.col("vector")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    for name in keys:
        fine &= F.col(name).isNotNull()
    queries, corpus = (rows.where(F.coalesce(fine, F.lit(False)) & F.col(name).isNotNull()).withColumn("_width", F.size(v)).select(F.col(name).cast("long").alias(name), "vector", *keys, "_width") for rows, name in ((queries, "query_id"), (corpus, "doc_id")))
    keys = [*keys, "_width"]
    scratch = Scratch(spark)
    scratch.drop_at_exit()
    widths = corpus.groupBy("_width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_width").collect()  # lengths are few
    n = sum(w.n for w in widths)
    wide = widths[0]["_width"] if widths else 0
    number = min(MOST_PIVOTS, -(-n // shard_rows))
    picked = corpus.where(F.col("_width") == wide).orderBy(F.xxhash64("doc_id"), "doc_id").limit(number if number > 1 else 0).collect()
    pivots = np.array([r.vector for r in picked], float).reshape(len(picked), wide)
    asked = scratch.cut(_placed(queries, pivots, wide, "query_id", keys, every=True))
    rows = scratch.cut(_placed(corpus, pivots, wide, "doc_id", keys, every=False))
    shards = rows.groupBy(*keys, "pivot").agg(F.count(F.lit(1)).alias("n"), F.min("apart").alias("near"), F.max("apart").alias("far"))
    shards = scratch.cut(shards.withColumn("pieces", F.ceil(F.col("n") / shard_rows).cast("int")))
    m = asked.count()
    blocks = max(1, -(-m // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    toward = asked.select("query_id", "block", *keys, F.posexplode_outer("all_apart").alias("pivot", "d")).withColumn("pivot", F.coalesce("pivot", F.lit(-1)))
    d = F.col("d")
    ring = F.greatest(d - F.col("far"), F.col("near") - d, F.lit(0.0)) - 1e-9 * (1 + d + F.col("far"))  # more than rounding
    pairs = scratch.cut(toward.join(shards, [*keys, "pivot"]).select("query_id", "block", *keys, "pivot", "pieces", "n", F.coalesce(ring, F.lit(-1.0)).alias("bound"), F.coalesce(d, F.lit(0.0)).alias("d")))
    order = Window.partitionBy("query_id", *keys).orderBy("bound", "d", "pivot")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = scratch.cut(pairs.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k).drop("before"))

    def compared(some: DataFrame) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
        left = rows.join(shards.select(*keys, "pivot", "pieces"), [*keys, "pivot"]).withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.col("pieces")).cast("int"))
        left = left.join(some.select(*keys, "pivot", "block").distinct(), [*keys, "pivot"]).select("doc_id", "vector", *keys, "pivot", "piece", "block")
        right = asked.select("query_id", "vector", *keys, "block").join(some.select("query_id", *keys, "pivot", "pieces").distinct(), ["query_id", *keys]).select("query_id", "vector", *keys, "pivot", each, "block")
        by = [*keys, "pivot", "piece", "block"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_near(k), "query_id long, doc_id long, distance double")

    early = scratch.cut(compared(first))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance"))
    reach = early.withColumn("place", place).where(F.col("place") == k).select("query_id", F.sqrt("distance").alias("reach"))
    rest = pairs.join(first.select("query_id", *keys, "pivot"), ["query_id", *keys, "pivot"], "left_anti").join(reach, "query_id", "left")
    later = scratch.cut(rest.where(F.col("reach").isNull() | (F.col("bound") <= F.col("reach"))))
    hits = early if later.isEmpty() else early.unionByName(compared(later))
    if read is not None:
        count = lambda df: df.agg(F.sum("n")).first()[0] or 0
        read.update(rows=count(pairs), compared=count(first) + count(later))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "doc_id", F.round("distance", 6).alias("distance"))


def _placed(rows: DataFrame, pivots: np.ndarray, wide: int, name: str, keys: list[str], every: bool) -> DataFrame:
    """*rows* with their nearest ``pivot`` and how far ``apart`` they are, or with the distances ``all_apart`` from every one. Rows of
    another length, and all where there are no pivots, have the pivot -1 and no distance."""
    if not len(pivots):
        return rows.withColumn("all_apart", F.lit(None).cast("array<double>")) if every else rows.withColumns({"pivot": F.lit(-1), "apart": F.lit(None).cast("double")})
    added = {"all_apart": F.lit(None).cast("array<double>")} if every else {"pivot": F.lit(-1), "apart": F.lit(None).cast("double")}
    schema, names = rows.withColumns(added).schema, list(added)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.flatnonzero(batch.column("_width").to_numpy() == wide)
            far = _distances(_vectors(batch.take(pa.array(own))), pivots) if len(own) else np.zeros((0, len(pivots)))
            if every:
                lists: list = [None] * batch.num_rows
                for i, line in zip(own.tolist(), far.tolist()):
                    lists[i] = line
                columns = [pa.array(lists, pa.list_(pa.float64()))]
            else:
                pivot, apart = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, np.nan)
                pivot[own], apart[own] = far.argmin(axis=1), far.min(axis=1)
                columns = [pa.array(pivot), pa.array(apart, mask=pivot < 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return rows.mapInArrow(place, schema)
