"""Hard-negative mining by exact search over a vector-approximation file.

Each shard of rows is stored as its approximation: every dimension is cut into cells of about equal filling, a row
keeps its cells (a byte for each dimension) and the shard keeps a table of the least and the greatest value met in each
cell. Looked up in that table, a row's bytes bound its score with any anchor from below and from above. The vectors
themselves stay where they are, eight times larger, and are fetched for candidates only.

Anchors meet shards in blocks. First an anchor's positives are found: rows of its label whose upper bound reaches the
k-th largest lower bound, of the shard and then of all shards, are scored exactly. Each positive's score then sets a
window; rows of other labels whose bounds may lie in the window, and whose upper bound reaches the k-th largest lower
bound among those that surely lie in it, are scored exactly, and the best k of the window remain. Bounds never exclude
a row that belongs to the result, so the result is exact.

Of rows with the same label and vector only the k + 1 least ids can ever be among the k best of an anchor; the others
are left out of the file, which keeps a group of many copies from filling every window. They are anchors like any other.

Defined cases: rows without an id, with a null label, a null vector, or any null or non-finite component take no part;
an id that is repeated is one row, of the least label and then the least vector; vectors of differing lengths are
compared in the dimensions both have; scores rank by smaller id when equal; a positive with a negative score has an
empty window; an anchor without positives, or a window without rows, gives no rows; an empty table gives none; other
columns play no part. Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm import workers
from kelpline.llm.topk_search import _matrix, quantise
from kelpline.session import Scratch, prepare

SHARD_ROWS, ANCHOR_BLOCK = 16384, 1024
CELLS = 256  # of a dimension
ANCHORS = 64  # whose bounds are held at once
LOWEST = np.iinfo(np.int64).min
FILE = "shard int, width int, ids array<long>, labels array<long>, low array<long>, high array<long>, cells binary"
FILE_SCHEMA = pa.schema([("shard", pa.int32()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("cells", pa.binary())])


def approximate(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the cell of each row in each dimension, least and greatest value of each cell in each dimension)."""
    rows, wide = vectors.shape
    cells = np.empty((rows, wide), np.uint8)
    low, high = np.zeros((wide, CELLS), np.int64), np.zeros((wide, CELLS), np.int64)
    for d in range(wide):
        sort = np.sort(vectors[:, d])
        edges = sort[np.arange(1, CELLS) * rows // CELLS]
        cells[:, d] = np.searchsorted(edges, vectors[:, d], side="right")
        begin = np.searchsorted(sort, edges, side="left")
        first, last = np.concatenate([[0], begin]), np.concatenate([begin, [rows]])
        filled = last > first
        low[d, filled], high[d, filled] = sort[first[filled]], sort[last[filled] - 1]
    return cells, low, high


class Approximation:
    """The bounds of rows, looked up from their cells."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray):
        every = np.arange(len(low))
        self.least, self.most = low[every, cells], high[every, cells]
        self.reach = int(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))) * len(low)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, anchors x rows."""
        # Sums of doubles are exact below 2^53; beyond, whole numbers of 64 bits are slower.
        kind = np.float64 if self.reach * int(np.abs(anchors).max(initial=0)) < 2**52 else np.int64
        up, down = np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
        least, most = self.least.T.astype(kind), self.most.T.astype(kind)
        return (up @ least + down @ most).astype(np.int64), (up @ most + down @ least).astype(np.int64)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, LOWEST if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), LOWEST)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


@workers.group
def _pack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("id")
    vectors = _matrix(rows.column("v"))
    cells, low, high = approximate(vectors)
    one = {"shard": rows.column("shard")[0].as_py(), "width": vectors.shape[1], "ids": rows.column("id").to_pylist(), "labels": rows.column("label").to_pylist()}
    return pa.Table.from_pylist([one | {"low": low.ravel().tolist(), "high": high.ravel().tolist(), "cells": cells.tobytes()}], FILE_SCHEMA)


def build_file(rows: DataFrame, k: int, shards: int) -> DataFrame:
    """The approximation of all *rows* (id, label, v), a row for each shard."""
    place = F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))
    fewest = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    sharded = fewest.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "label", "v")
    return sharded.groupBy("shard").applyInArrow(_pack, FILE)


class _Shard:
    def __init__(self, row: dict):
        self.ids, self.labels, self.width = np.array(row["ids"], np.int64), np.array(row["labels"], np.int64), row["width"]
        low, high = (np.array(row[c], np.int64).reshape(self.width, CELLS) for c in ("low", "high"))
        self.held = Approximation(np.frombuffer(row["cells"], np.uint8).reshape(len(self.ids), self.width), low, high)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        anchors = anchors[:, : self.width]
        return self.held.bounds(np.pad(anchors, ((0, 0), (0, self.width - anchors.shape[1]))))


CANDIDATES = "anchor_id long, positive_id long, positive_score long, vec_id long, lower long, upper long, sure boolean"
CANDIDATE_SCHEMA = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("lower", pa.int64()), ("upper", pa.int64()), ("sure", pa.bool_())])


def _candidates(found: list[dict]) -> pa.Table:
    found = [pa.table({f.name: pa.array(c[f.name], f.type) for f in CANDIDATE_SCHEMA}, CANDIDATE_SCHEMA) for c in found]
    return pa.concat_tables([CANDIDATE_SCHEMA.empty_table(), *found])


def _near(shard: _Shard, ids: np.ndarray, labels: np.ndarray, lower: np.ndarray, upper: np.ndarray, k: int) -> dict:
    """Rows of the anchor's label that may be among its k best."""
    own = (shard.labels == labels[:, None]) & (shard.ids != ids[:, None])
    floor = _kth(np.where(own, lower, LOWEST), k)
    a, r = np.nonzero(own & (upper >= floor[:, None]))
    nothing = pa.nulls(len(a), pa.int64())
    return {"anchor_id": ids[a], "positive_id": nothing, "positive_score": nothing, "vec_id": shard.ids[r], "lower": lower[a, r], "upper": upper[a, r], "sure": np.ones(len(a), bool)}


def _inside(shard: _Shard, ids: np.ndarray, labels: np.ndarray, lower: np.ndarray, upper: np.ndarray, k: int, positive: np.ndarray, score: np.ndarray, window: np.ndarray) -> dict:
    """Rows of other labels that may be among the k best of the window of one positive of each anchor."""
    least, most = window[:, :1], window[:, 1:]
    other = (shard.labels != labels[:, None]) & (upper >= least) & (lower <= most)
    sure = other & (lower >= least) & (upper <= most)
    floor = _kth(np.where(sure, lower, LOWEST), k)
    a, r = np.nonzero(other & (upper >= floor[:, None]))
    return {"anchor_id": ids[a], "positive_id": positive[a], "positive_score": score[a], "vec_id": shard.ids[r], "lower": lower[a, r], "upper": upper[a, r], "sure": sure[a, r]}


def _search(k: int):
    @workers.group
    def search(file: pa.Table, asked: pa.Table) -> pa.Table:
        if not file.num_rows or not asked.num_rows:
            return CANDIDATE_SCHEMA.empty_table()
        shard, found = _Shard(file.to_pylist()[0]), []
        for first in range(0, asked.num_rows, ANCHORS):
            some = asked.slice(first, ANCHORS)
            ids, labels, anchors = some.column("id").to_numpy(), some.column("label").to_numpy(), _matrix(some.column("v"))
            lower, upper = shard.bounds(anchors)
            if "windows" not in some.column_names:
                found.append(_near(shard, ids, labels, lower, upper, k))
                continue
            windows = some.column("windows").to_pylist()
            for turn in range(max(map(len, windows), default=0)):
                own = np.array([i for i, w in enumerate(windows) if len(w) > turn])
                asks = [windows[i][turn] for i in own]
                told = [np.array([w[c] for w in asks], np.int64) for c in ("positive_id", "positive_score")]
                window = np.array([(w["least"], w["most"]) for w in asks], np.int64)
                found.append(_inside(shard, ids[own], labels[own], lower[own], upper[own], k, *told, window))
        return _candidates(found)

    return search


def _bounded(file: DataFrame, anchors: DataFrame, shards: int, blocks: int, k: int) -> DataFrame:
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = anchors.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    return file.withColumn("block", every(blocks)).groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(_search(k), CANDIDATES)


def _scored(candidates: DataFrame, rows: DataFrame, anchors: DataFrame, k: int, by: list[str], scratch: Scratch) -> DataFrame:
    """Candidates that the bounds of all shards leave, with their exact ``score``."""
    candidates = scratch.cut(candidates)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("lower")))
    floors = candidates.where("sure").withColumn("place", place).where(F.col("place") == k).select(*by, F.col("lower").alias("floor"))
    left = candidates.join(floors, by, "left").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    product = F.aggregate(F.zip_with("a", "v", lambda x, y: F.coalesce(x * y, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    met = left.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(anchors.select(F.col("id").alias("anchor_id"), F.col("v").alias("a")), "anchor_id")
    return met.withColumn("score", product).drop("v", "a")


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
    key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: int = 256, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row for which *is_anchor* (of ``id``)
    holds: for each of its first *positives* rows of its label, the first *negatives* rows of other labels that score at least
    *least* and at most *most* hundredths of the positive's score. Runs at once: candidates are stored in between."""
    prepare(vectors.sparkSession)
    named = F.col(label) if isinstance(label, str) else label
    taken = vectors.select(F.col(key).cast("long").alias("id"), named.cast("long").alias("label"), quantise(F.col(vector), scale).alias("v")).dropna()
    scratch = Scratch(vectors.sparkSession)
    scratch.drop_at_exit()
    rows = scratch.cut(taken.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.*"))
    anchors = rows.where(is_anchor)
    count, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    shards, blocks = max(1, -(-count // shard_rows)), max(1, -(-asked // ANCHOR_BLOCK))
    file = scratch.cut(build_file(rows, max(positives, negatives), shards))

    first = lambda df, by, n: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= n)
    near = _scored(_bounded(file, anchors, shards, blocks, positives), rows, anchors, positives, ["anchor_id"], scratch)
    windows = first(near, ["anchor_id"], positives).select(
        "anchor_id",
        F.struct(
            F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
            F.ceil(F.col("score") * least / F.lit(100).cast("decimal(3,0)")).cast("long").alias("least"),
            F.floor(F.col("score") * most / F.lit(100).cast("decimal(3,0)")).cast("long").alias("most"),
        ).alias("window"),
    ).where(F.col("window.least") <= F.col("window.most"))
    asks = anchors.join(windows.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list("window")).alias("windows")), "id")
    pair = ["anchor_id", "positive_id"]
    found = _scored(_bounded(file, scratch.cut(asks), shards, blocks, negatives), rows, anchors, negatives, pair, scratch)
    in_window = (F.lit(least) * F.col("positive_score") <= 100 * F.col("score")) & (100 * F.col("score") <= F.lit(most) * F.col("positive_score"))
    return first(found.where(in_window), pair, negatives).select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
