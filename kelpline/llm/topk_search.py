"""Exact top-k by integer inner product with MaxScore over sharded postings.

A vector's components, turned into integers, are weighted terms: dimension and sign. A shard of documents is cut
into blocks of growing length; each block has one posting list per term, with the largest weight as its bound. A
query meets the list of its own sign in each of its dimensions. With its terms by rising bound, those whose bounds
together cannot lift a document to the current k-th score are non-essential: only essential lists are traversed;
the documents that can still make it are probed in the others, largest bounds first, as long as the bounds left
keep them competitive. Weights of opposite sign only lower a score and are taken off with the essential lists.
After each block the k-th score of every query, its floor, rises. The shards' results are merged. Many queries are taken through a block
at once, each with its own essential lists.

Queries and shards meet in blocks: each block of queries goes to each shard, so nothing is broadcast.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; vectors of differing lengths are compared in the dimensions both have; equal scores rank by smaller id;
repeated rows of an id are ranked each, except that a query never meets its own id; repeated query rows of an id
are one query, of the least vector if they differ; a query with fewer than k others gets all of them; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm import workers
from kelpline.session import prepare

SHARD_ROWS, QUERY_BLOCK = 4096, 4096
FIRST_BLOCK, LAST_BLOCK = 64, 1024  # documents
QUERIES = 512  # that go through a block at once
PROBES = 16  # lists that are probed before competitiveness is looked at again
SCALE = 256


class Block:
    """Postings of a run of documents: a weight for each term (0: not in its list), and each list's largest weight."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.postings = np.concatenate([np.maximum(vectors, 0), np.maximum(-vectors, 0)], axis=1)
        self.bounds = self.postings.max(axis=0, initial=0)


def competitive(block: Block, query_ids: np.ndarray, lifts: np.ndarray, lowers: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of all pairs of a block that reach the query's floor. *lifts* and *lowers* are terms x queries."""
    limits = block.bounds[:, None] * lifts
    order = np.argsort(limits, axis=0, kind="stable")
    upto = np.cumsum(np.take_along_axis(limits, order, 0), axis=0)
    spare = upto < floors  # terms, by rising bound, that together stay below the floor
    count = spare.sum(0)
    left = np.where(count > 0, np.take_along_axis(upto, np.maximum(count - 1, 0)[None], 0)[0], 0)
    essential = lifts.copy()
    np.put_along_axis(essential, order, np.where(spare, 0, np.take_along_axis(lifts, order, 0)), 0)
    part = block.postings @ essential - block.postings @ lowers
    docs, queries = np.nonzero((part + left >= floors) & (block.ids[:, None] != query_ids[None]))
    score, left, at = part[docs, queries], left[queries], count[queries].copy()
    while (at > 0).any():
        # The next non-essential lists of each pair, largest bounds first.
        places = at[:, None] - 1 - np.arange(PROBES)
        terms = order[np.maximum(places, 0), queries[:, None]]
        weight = np.where(places >= 0, lifts[terms, queries[:, None]], 0)
        score = score + (block.postings[docs[:, None], terms] * weight).sum(1)
        left = left - (block.bounds[terms] * weight).sum(1)
        at = np.maximum(at - PROBES, 0)
        keep = score + left >= floors[queries]
        docs, queries, score, left, at = docs[keep], queries[keep], score[keep], left[keep], at[keep]
    return queries, docs, score


def best_of(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k best of a shard for each query."""
    wide = max(vectors.shape[1], asked.shape[1])
    vectors, asked = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (vectors, asked))
    # Sums of doubles are exact below 2^53; beyond, whole numbers of 64 bits are slower.
    exact = float(np.abs(vectors).max(initial=0)) * float(np.abs(asked).max(initial=0)) * wide < 2.0**52
    kind, nothing = (np.float64, -np.inf) if exact else (np.int64, np.iinfo(np.int64).min // 2)
    order = np.argsort(ids, kind="stable")
    ids, vectors, asked = ids[order], vectors[order].astype(kind), asked.astype(kind)
    lifts = np.concatenate([np.maximum(asked, 0), np.maximum(-asked, 0)], axis=1).T.copy()
    lowers = np.concatenate([np.maximum(-asked, 0), np.maximum(asked, 0)], axis=1).T.copy()
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)]
    floors = np.full(len(asked), nothing, kind)
    start, length = 0, FIRST_BLOCK
    while start < len(ids):
        block = Block(ids[start : start + length], vectors[start : start + length])
        start, length = start + length, min(2 * length, LAST_BLOCK)
        queries, docs, score = competitive(block, query_ids, lifts, lowers, floors)
        who, what, much = (np.concatenate([h, n]) for h, n in zip(held, (queries, block.ids[docs], score)))
        sort = np.lexsort((what, -much, who))
        who, what, much = who[sort], what[sort], much[sort]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        held = [x[place < k] for x in (who, what, much)]
        floors[who[place == k - 1]] = much[place == k - 1]
    return held[0], held[1], held[2].astype(np.int64)


def quantise(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as double; null for vectors that take no part."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(fine, whole)


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    rows = column.combine_chunks()
    values, ends = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(rows.offsets.to_numpy())
    wide = max(int(ends.max(initial=0)), 1)
    out = np.zeros((len(ends), wide), np.int64)
    out[np.repeat(np.arange(len(ends)), ends), np.arange(len(values)) - np.repeat(np.cumsum(ends) - ends, ends)] = values
    return out


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of all rows for each row for which *is_query* (of ``id``) holds."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("id"), quantise(F.col(vector)).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    count, queries = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-count // SHARD_ROWS)), max(1, -(-queries // QUERY_BLOCK))
    pick = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    docs = rows.withColumn("shard", pick(shards, "shard")).select("id", "v", "shard", every(blocks).alias("block"))
    single = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    asks = single.withColumn("block", pick(blocks, "block")).select("id", "v", "block", every(shards).alias("shard"))

    @workers.group
    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return FOUND.empty_table()
        ids, vectors, query_ids, queries = own.column("id").to_numpy(), _matrix(own.column("v")), asked.column("id").to_numpy(), _matrix(asked.column("v"))
        made = []
        for a in range(0, len(query_ids), QUERIES):
            some = query_ids[a : a + QUERIES]
            who, what, much = best_of(ids, vectors, some, queries[a : a + QUERIES], k)
            made.append(pa.table([pa.array(some[who]), pa.array(what), pa.array(much)], schema=FOUND))
        return pa.concat_tables(made)

    met = docs.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(search, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
