"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors of a label become one class with a count. In each of several trees, cells of a label are split
again and again at the median of a random projection; vectors near the cut go to both sides (spill). Cells
still too large for a task are split by Spark, level by level, over all rows; smaller cells are split further in
their task down to leaves. Vectors are compared within leaves, and the links found are joined into components. A
cell that spill keeps from shrinking, as a dense group of near copies does, is compared in pairs of blocks of
its rows. Links within each component are then counted exactly, again in pairs of blocks, so that no list of
pairs is ever written.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, null labels and null
ids link with nothing; vectors of differing length never link; repeated rows count as vectors of their own, and
so do rows of one id with different labels or vectors: an id says nothing about links, and ``kept`` holds for each of its
rows whose component has no smaller id; a table without links gives every vector as its own component; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm import workers
from kelpline.llm.components import connected
from kelpline.session import Scratch, cut, prepare

TREES = 6
SPILL = 0.03  # of a unit projection, on each side of the cut
CELL, LEAF, BLOCK = 8192, 256, 4096
SMALL, SPREAD = 256, 32  # a group is dealt out in up to SPREAD blocks of SMALL rows and more, then in blocks of BLOCK


def _direction(*path) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(path).encode(), digest_size=8).digest()))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float64)


def _links(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    return (x @ y.T) / (nx[:, None] * ny[None, :]) >= least


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def _leaf_links(x: np.ndarray, own: np.ndarray, joined: _Union, least: float) -> None:
    """Joins the linked rows among *own*: a row is compared with its block only until nothing new can come."""
    for a in range(0, len(own), 1024):
        i, j = np.nonzero(_links(x[own[a : a + 1024]], x[own[a:]], least))
        for p, q in zip(own[a + i].tolist(), own[a + j].tolist()):
            if p < q:
                joined.join(p, q)


def _split(x: np.ndarray, own: np.ndarray, path: tuple, joined: _Union, least: float) -> None:
    stack = [(own, path)]
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    while stack:
        own, path = stack.pop()
        if len(own) > LEAF:
            line = _direction(*path).normal(size=x.shape[1])
            at = unit[own] @ (line / np.sqrt((line * line).sum()))
            middle = np.median(at)
            sides = own[at <= middle + SPILL], own[at >= middle - SPILL]
            if max(map(len, sides)) < 0.9 * len(own):
                stack += [(side, (*path, k)) for k, side in enumerate(sides)]
                continue
        _leaf_links(x, own, joined, least)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(ids: np.ndarray, joined: _Union) -> pa.Table:
    """For each group, its members tied in a tree of degree three at most: no row per link, no node of many edges."""
    groups: dict[int, list[int]] = {}
    for i in range(len(ids)):
        groups.setdefault(joined.root(i), []).append(int(ids[i]))
    pairs = [(g[(i - 1) // 2], g[i]) for g in map(sorted, groups.values()) for i in range(1, len(g))]
    return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=EDGES)


def _compare_cell(key: tuple, rows: pa.Table, least: float) -> pa.Table:
    tree, node, first, second = (k.as_py() for k in key)
    rows = rows.sort_by("id")
    ids, x, block = rows.column("id").to_numpy(), _matrix(rows.column("v")), rows.column("own_block").to_numpy()
    joined = _Union(len(ids))
    if first == second == -1:
        _split(x, np.arange(len(ids)), (tree, node), joined, least)
    else:
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        for a in range(0, len(left), 512):
            i, j = np.nonzero(_links(x[left[a : a + 512]], x[right], least))
            for p, q in zip(left[a + i].tolist(), right[j].tolist()):
                joined.join(p, q)
    return _edges(ids, joined)


@workers.task
def _project(batches):
    for batch in batches:
        x = _matrix(batch.column("v")) if batch.num_rows else np.zeros((0, 1))
        lengths = np.sqrt((x * x).sum(1)) if len(x) else np.zeros(0)
        at = np.zeros(len(x))
        keys = np.array([f"{t}|{n}" for t, n in zip(batch.column("tree").to_pylist(), batch.column("node").to_pylist())])
        for key in np.unique(keys):
            own = np.flatnonzero(keys == key)
            line = _direction("cell", key).normal(size=x.shape[1])
            at[own] = x[own] @ (line / np.sqrt((line * line).sum())) / lengths[own]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("node"), batch.column("id"), pa.array(at)], ["tree", "node", "id", "at"])


def _cells(classes: DataFrame, trees: int, cell: int, scratch: Scratch) -> DataFrame:
    """(tree, node, id, cell_rows): cells of at most *cell* rows, or that no longer shrink."""
    cut = scratch.cut
    every = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    state = classes.select(every, F.concat_ws(":", "label", F.size("v")).alias("node"), "id")
    sizes = state.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"))
    state = cut(state.join(sizes, ["tree", "node"]))
    done = []
    while True:
        done.append(state.where(F.col("n") <= cell))
        large = state.where(F.col("n") > cell)
        if large.isEmpty():
            break
        whole = large.join(classes.select("id", "v"), "id").select("tree", "node", "id", "v")
        at = cut(whole.mapInArrow(_project, "tree int, node string, id long, at double"))
        middles = at.groupBy("tree", "node").agg(F.percentile_approx("at", 0.5, 1000).alias("middle"), F.count(F.lit(1)).alias("parent"))
        placed = at.join(cut(middles), ["tree", "node"])
        sides = F.filter(
            F.array(F.when(F.col("at") <= F.col("middle") + SPILL, 0), F.when(F.col("at") >= F.col("middle") - SPILL, 1)),
            lambda s: s.isNotNull(),
        )
        split = placed.select("tree", F.col("node").alias("up"), "id", "parent", F.explode(sides).alias("side")).withColumn("node", F.concat_ws("/", "up", "side"))
        children = cut(split.groupBy("tree", "up", "node", "parent").agg(F.count(F.lit(1)).alias("n")))
        stuck = children.where(F.col("n") >= 0.9 * F.col("parent")).select("tree", "up").distinct()
        shrunk = children.join(stuck, ["tree", "up"], "left_anti")
        done.append(large.join(stuck.withColumnRenamed("up", "node"), ["tree", "node"], "left_semi"))
        state = cut(split.join(shrunk.select("tree", "node", "n"), ["tree", "node"]).select("tree", "node", "id", "n"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _blocks(block: int) -> Column:
    """The number of blocks of a group of ``n`` rows."""
    rows = F.least(F.lit(block), F.greatest(F.lit(min(SMALL, block)), F.ceil(F.col("n") / SPREAD)))
    return F.ceil(F.col("n") / rows).cast("int")


def near_duplicates(vectors: DataFrame, least: float = 0.98, trees: int = TREES, cell: int = CELL, block: int = BLOCK, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    prepare(vectors.sparkSession)
    v = F.col("v")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    taken = rows.where(F.coalesce(fine, F.lit(False)))
    grouped = taken.groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    scratch = Scratch(vectors.sparkSession)
    # Classes have numbers of their own, fixed by storing them: one vec_id may stand in several.
    classes = scratch.cut(grouped.select(F.monotonically_increasing_id().alias("id"), "least", "label", "v", "copies"))
    cells = _cells(classes, trees, cell, scratch).join(classes.select("id", "v"), "id")
    blocks = _blocks(block)
    own_block = F.when(F.col("n") <= cell, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), blocks).cast("int"))
    b = F.col("own_block")
    pairs = F.when(b < 0, F.array(F.struct(b.alias("first"), b.alias("second")))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(b, o).alias("first"), F.greatest(b, o).alias("second")))
    )
    dealt = cells.withColumn("own_block", own_block).withColumn("pair", F.explode(pairs)).select("tree", "node", "pair.first", "pair.second", "id", "v", "own_block")
    found = dealt.groupBy("tree", "node", "first", "second").applyInArrow(lambda key, rows: _compare_cell(key, rows, least), "a long, b long")
    linked = connected(scratch.cut(found), scratch)  # stored: the vectors are compared once
    named = classes.join(linked, classes["id"] == linked["node"]).groupBy("component").agg(F.min("least").alias("component_id"))
    counted = count_links(classes.join(linked, classes["id"] == linked["node"]).select("component", "id", "v", "copies", "label"), least, scratch, block)
    known = classes.join(counted, "id", "left").join(linked, classes["id"] == linked["node"], "left").join(named, "component", "left").select(
        F.col("label").alias("class_label"), F.col("v").alias("class_v"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    known = cut(known)  # all that the result reads
    scratch.drop()
    found = taken.join(known, (taken["label"] == known["class_label"]) & (taken["v"] == known["class_v"])).select(F.col("id").alias(key), "n_links", "component_id")
    apart = rows.where(~F.coalesce(fine, F.lit(False))).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.union(apart).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


COUNTS = pa.schema([("id", pa.int64()), ("others", pa.int64())])


def _count_pair(rows: pa.Table, least: float) -> pa.Table:
    own = rows.filter(rows.column("asks"))
    x, y = _matrix(own.column("v")), _matrix((other := rows.filter(pc.invert(rows.column("asks")))).column("v"))
    ids, others, copies = own.column("id").to_numpy(), other.column("id").to_numpy(), other.column("copies").to_numpy()
    made = np.zeros(len(ids), np.int64)
    for a in range(0, len(ids), 512):
        hit = _links(x[a : a + 512], y, least) & (ids[a : a + 512, None] != others[None, :])
        made[a : a + 512] = hit @ copies
    return pa.table([pa.array(ids), pa.array(made)], schema=COUNTS)


def count_links(members: DataFrame, least: float, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(id, others): linked vectors of other classes in the same component, counted by pairs of blocks of its rows."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    blocks = _blocks(block)
    dealt = members.join(scratch.cut(sizes), "component").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    every = F.sequence(F.lit(0), blocks - 1)
    roles = F.flatten(F.transform(every, lambda o: F.array(
        F.struct(F.col("own").alias("first"), o.alias("second"), F.lit(True).alias("asks")),
        F.struct(o.alias("first"), F.col("own").alias("second"), F.lit(False).alias("asks")),
    )))
    pairs = dealt.select("component", "id", "v", "copies", F.explode(roles).alias("role")).select("component", "role.*", "id", "v", "copies")
    counted = pairs.groupBy("component", "first", "second").applyInArrow(lambda rows: _count_pair(rows, least), "id long, others long")
    return counted.groupBy("id").agg(F.sum("others").alias("others"))
