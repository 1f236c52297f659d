"""A stored inverted index with block bounds, and BM25 over it that skips what cannot reach the k best.

Documents are cut into cells of CELL_DOCS; a cell holds documents of one value of the kept columns only, and of those that a
task holds at a time the ones with the same most frequent terms, so that a cell's documents are alike. Cells are stored
whole, postings by term. Beside them, each term has a row for each cell it occurs in, with the largest impact there (the
part of a score that does not depend on the query); these bounds are stored by bucket of their term and sorted by it, so a
query reads those of its own terms only. A cell's bound for a query is the weighted sum of its terms' bounds. The few
cells with the highest bounds are scored first; the k-th score found is the query's floor, and of the other cells only
those whose bound reaches it are read at all.

Documents without any term of a query score zero and fill its list by id. Documents without an id count in the
statistics but are not ranked; rows of a repeated id are ranked each. Ranks go by scores of ten decimals, then by id.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kelpline.functions import text as tx
from kelpline.session import Scratch, input_bytes, prepare

K1, B, EPSILON = 1.5, 0.75, 0.25
CELL_DOCS = 64
HELD_DOCS, HELD_TOKENS = 4096, 1 << 20  # that a task holds before it cuts them into cells
BUCKETS = 64
PART_BYTES = 64 << 20  # of text, whose blocks one task sorts
SMALL = 256 << 20  # bytes of input that are dealt out before they are read
LOT_CELLS = 16  # cells that are scored in one group
#: How cells are written: Spark's reader decodes up to 4,096 rows of a row group at once, lists with levels of four bytes for each
#: value. So postings are bytes and terms are one string, which take what is stored; row groups are small, and are measured from
#: the first few (large) rows on.
WRITTEN = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "4"}
ALIKE = 2  # most frequent terms by which documents are put side by side
SEEDS = 2  # cells that are scored to find a floor
_RUNS, _CJK = re.compile(tx.RAW_RUNS), re.compile(tx.CJK)


@dataclass
class Inverted:
    """``bounds`` (term, cell, n, top, kept columns, bucket), ``cells`` (kept columns, cell, ids, lengths and the postings of
    their documents), ``terms`` (term, df, idf)."""

    bounds: DataFrame
    cells: DataFrame
    terms: DataFrame

    def sizes(self) -> tuple[int, int, int]:
        """(cells, documents, tokens)."""
        row = self.cells.agg(F.count(F.lit(1)), F.sum("n_docs"), F.sum("n_tokens")).first()
        return row[0], row[1] or 0, row[2] or 0


def index_tokens(text: str) -> list[str]:
    """What ``functions.text.index_tokens`` gives, in Python."""
    out = []
    for run in _RUNS.findall(text):
        if _CJK.match(run):
            out += [run[i : i + 2] for i in range(max(len(run) - 1, 1))]
        else:
            out.append(run.lower())
    return out


CELL = "cell long, n_docs long, n_tokens long, ids array<long>, lengths array<int>, terms string, ends array<int>, places binary, tfs binary"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the fewest bytes that hold the largest."""
    return values.astype(np.min_scalar_type(values.max(initial=0)).newbyteorder("<")).tobytes()


def _unpacked(value: pa.Scalar, n: int) -> np.ndarray:
    data = value.as_buffer()
    return np.frombuffer(data, f"<u{data.size // n}") if n else np.zeros(0, np.uint8)


def _split(terms: pa.Scalar) -> pa.Array:
    """The terms of a cell; none holds a blank."""
    return pc.split_pattern(pa.array([terms.as_py()], pa.string()), " ").flatten() if len(terms.as_buffer()) else pa.array([], pa.string())


def _cell(number: int, docs: list[tuple]) -> dict:
    """A cell of (id, length, counts): its terms, the postings of all of them one after another, where each term's end, and in
    which document of the cell each is."""
    numbers: dict[str, int] = {}
    of = np.array([numbers.setdefault(term, len(numbers)) for _, _, counts in docs for term in counts], np.int64)
    order = np.argsort(of, kind="stable")
    tfs = np.fromiter(itertools.chain.from_iterable(counts.values() for _, _, counts in docs), np.int64, len(of))
    places, lengths = np.repeat(np.arange(len(docs)), [len(counts) for _, _, counts in docs]), [d[1] for d in docs]
    return {
        "cell": number, "n_docs": len(docs), "n_tokens": sum(lengths), "ids": [d[0] for d in docs], "lengths": lengths, "terms": " ".join(numbers),
        "ends": np.cumsum(np.bincount(of, minlength=len(numbers))).tolist(), "places": _packed(places[order]), "tfs": _packed(tfs[order]),
    }


def _cells(docs: DataFrame, keep: Sequence[str], doc: str, text: str, cell_docs: int) -> DataFrame:
    kept = [f"keep_{c}" for c in keep]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = StructType([*rows.schema.fields[: len(keep)], *StructType.fromDDL(CELL).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, number, held, size = to_arrow_schema(out), TaskContext.get().partitionId() << 32, [], 0

        def cells() -> Iterator[pa.RecordBatch]:
            nonlocal number
            held.sort(key=lambda d: (*((v is not None, v) for v in d[0]), d[1]))
            for _, group in itertools.groupby(held, key=lambda d: d[0]):
                group = list(group)
                for first in range(0, len(group), cell_docs):
                    own = group[first : first + cell_docs]
                    made = _cell(number, [d[2:] for d in own])
                    row = dict(zip(kept, own[0][0])) | made
                    yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)
                    number += 1

        for batch in batches:
            for *key, doc_id, body in zip(*(batch.column(n).to_pylist() for n in (*kept, "doc_id", "text"))):
                counts = Counter(index_tokens(body))
                alike = tuple(heapq.nsmallest(ALIKE, counts, key=lambda t: (-counts[t], t)))
                held.append((tuple(key), alike, doc_id, counts.total(), counts))
                size += counts.total()
                if len(held) >= max(HELD_DOCS, cell_docs) or size > HELD_TOKENS:
                    yield from cells()
                    held, size = [], 0
        yield from cells()

    named = rows.mapInArrow(cut, out)
    return named.toDF(*keep, *named.columns[len(keep) :])


def _impacts(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean or 1.0)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each row's begin and end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    return column.values.slice(0, ends[-1] if len(ends) else 0), ends


def _bounds(cells: DataFrame, keep: Sequence[str], mean: float) -> DataFrame:
    """(kept columns, cell, term, n, top): each term of each cell with the number of its documents and its largest impact."""
    own = [f"keep_{c}" for c in keep]
    rows = cells.select(*[F.col(c).alias(k) for c, k in zip(keep, own)], "cell", "lengths", "terms", "ends", "places", "tfs")
    out = StructType([*rows.schema.fields[: len(keep)], *StructType.fromDDL("cell long, term string, n long, top double").fields])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                lengths, ends = (row.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("lengths", "ends"))
                if len(ends):
                    places, tfs = (_unpacked(row.column(c)[0], ends[-1]) for c in ("places", "tfs"))
                    begins = np.concatenate([[0], ends[:-1]])
                    top = np.maximum.reduceat(_impacts(tfs.astype(float), lengths[places], mean), begins)
                    whole = [pa.array([v.as_py()] * len(ends), v.type) for v in (row.column(c)[0] for c in (*own, "cell"))]
                    yield pa.RecordBatch.from_arrays([*whole, _split(row.column("terms")[0]), pa.array((ends - begins).astype(np.int64)), pa.array(top)], [*own, "cell", "term", "n", "top"])

    named = rows.mapInArrow(bounded, out)
    return named.toDF(*keep, *named.columns[len(keep) :])


def build(docs: DataFrame, store: Callable[..., DataFrame], keep: Sequence[str] = (), doc: str = "doc_id", text: str = "text", cell_docs: int = CELL_DOCS) -> Inverted:
    """Indexes *docs*. *store* keeps a table under a name, in folders by the columns *by*, as WRITTEN says, and reads it back: ``store(name, df, by)``."""
    spark = docs.sparkSession
    prepare(spark)
    if input_bytes(docs) < SMALL:  # which may lie in one split
        docs = docs.repartition(spark.sparkContext.defaultParallelism)
    cells = store("cells", _cells(docs, keep, doc, text, cell_docs), ())
    n, total = cells.agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKETS), input_bytes(docs) // PART_BYTES)
    order = ["bucket", "term", "cell"]
    bounded = _bounds(cells, keep, (total or 0) / (n or 1)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    bounds = store("bounds", bounded.repartitionByRange(parts, *order).sortWithinPartitions(*order), ("bucket",))
    frequencies = bounds.groupBy("term").agg(F.sum("n").alias("df"))
    raw = store("raw", frequencies.withColumn("raw", F.ln((F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))), ())
    floor = (raw.agg(F.avg("raw")).first()[0] or 0.0) * EPSILON
    return Inverted(bounds, cells, raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf")))


FOUND = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
NO_ID = np.iinfo(np.int64).min


def _score(cells: pa.Table, asked: pa.Table, k: int, mean: float) -> pa.Table:
    """The k best of some cells for each query that asks for one of them."""
    query_ids = asked.column("query_id").to_numpy()
    words, word_ends = _flat(asked.column("terms"))
    weights, wanted = _flat(asked.column("weights"))[0].to_numpy(), _flat(asked.column("cells"))
    spoken = words.unique()
    word = pc.index_in(words, value_set=spoken).to_numpy()
    who, what = np.repeat(np.arange(len(query_ids)), np.diff(wanted[1])), wanted[0].to_numpy()
    floors, found = np.full(len(query_ids), -np.inf), [[], [], []]
    for row in range(cells.num_rows):
        value = lambda c: cells.column(c)[row].values  # noqa: E731, B023
        own = who[what == cells.column("cell")[row].as_py()]
        number = pc.index_in(_split(cells.column("terms")[row]), value_set=spoken).fill_null(-1).to_numpy()
        if not len(own) or not (number >= 0).any():
            continue
        ids, lengths = value("ids").fill_null(NO_ID).to_numpy(), value("lengths").to_numpy()
        ends = value("ends").to_numpy()
        counts = np.diff(ends, prepend=0)
        place_of = np.full(len(spoken), -1)
        met = np.flatnonzero(number >= 0)
        place_of[number[met]] = np.arange(len(met))
        entry = np.arange(counts[met].sum()) + np.repeat(ends[met] - np.cumsum(counts[met]), counts[met])
        places, tfs = (_unpacked(cells.column(c)[row], ends[-1])[entry] for c in ("places", "tfs"))
        impacts = np.zeros((len(met), len(ids)))
        impacts[np.repeat(np.arange(len(met)), counts[met]), places] = _impacts(tfs.astype(float), lengths[places], mean)
        sizes = np.diff(word_ends)[own]
        entry = np.arange(sizes.sum()) + np.repeat(word_ends[own] - (np.cumsum(sizes) - sizes), sizes)
        at, query = place_of[word[entry]], np.repeat(np.arange(len(own)), sizes)
        matrix = np.zeros((len(own), len(met)))
        matrix[query[at >= 0], at[at >= 0]] = weights[entry[at >= 0]]
        scores = np.round(matrix @ impacts, 10)
        q, d = np.nonzero((scores != 0) & ((scores >= floors[own][:, None]) | (scores < 0)) & (ids != NO_ID))
        for held, new in zip(found, (own[q], ids[d], scores[q, d])):
            held.append(new)
        if len(d):
            found = [[x] for x in _best(*map(np.concatenate, found), k, floors)]
    if not found[0]:
        return FOUND.empty_table()
    who, what, much = map(np.concatenate, found)
    return pa.table([pa.array(query_ids[who]), pa.array(what), pa.array(much)], schema=FOUND)


def _best(who: np.ndarray, what: np.ndarray, much: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best of each query, and all below zero, which must not be taken for documents without a term; raises the floors."""
    order = np.lexsort((what, -much, who))
    who, what, much = who[order], what[order], much[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    floors[who[place == k - 1]] = much[place == k - 1]
    return tuple(x[(place < k) | (much < 0)] for x in (who, what, much))


def search(
    index: Inverted, queries: DataFrame, k: int = 10, symmetric: bool = True, among: Column | None = None,
    query: str = "query_id", words: str = "query", seeds: int = SEEDS, read: dict | None = None,
) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query. ``among``, an expression of the kept columns, limits
    what is ranked but not the corpus statistics. *read* is told how many blocks of the queries' terms there are and how many
    were read. Runs at once: what is read depends on the first scores."""
    prepare(queries.sparkSession)
    scratch = Scratch(queries.sparkSession)
    scratch.drop_at_exit()
    n_cells, n_docs, n_tokens = index.sizes()
    mean, lots = n_tokens / (n_docs or 1), max(1, -(-n_cells // LOT_CELLS))
    tokens = (tx.index_tokens if symmetric else tx.raw_tokens)(F.col(words))
    asked = queries.where(F.col(query).isNotNull()).select(F.col(query).cast("long").alias("query_id"), F.explode_outer(tokens).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count("term").alias("qtf"))
    weighted = scratch.cut(asked.join(index.terms, "term", "left").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")))
    live = weighted.where(F.col("weight") != 0)
    buckets = [r.bucket for r in live.select("bucket").distinct().collect()]  # BUCKETS at most
    allowed = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    tops, cells = index.bounds.where(F.col("bucket").isin(buckets) & allowed), index.cells.where(allowed)
    lifted = F.sum(F.greatest("weight", F.lit(0.0)) * F.col("top"))
    bounds = scratch.cut(tops.select("term", "cell", "top").join(live.select("query_id", "term", "weight"), "term").groupBy("query_id", "cell").agg(lifted.alias("bound"), F.count(F.lit(1)).alias("blocks")))
    vectors = live.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("v"))  # a query's words
    vectors = scratch.cut(vectors.select("query_id", F.col("v.term").alias("terms"), F.col("v.weight").alias("weights")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell"))
    first = scratch.cut(bounds.withColumn("place", place).where(F.col("place") <= seeds).drop("place"))
    lot = F.pmod(F.xxhash64("cell"), F.lit(lots)).cast("int").alias("lot")

    def scored(pairs: DataFrame) -> DataFrame:
        few = scratch.cut(pairs.select("cell").distinct())  # a number each; the planner would take it for as large as the pairs and sort whole cells
        chosen = cells.join(few, "cell", "left_semi").select(lot, "cell", "ids", "lengths", "terms", "ends", "places", "tfs")
        wanted = pairs.groupBy("query_id", lot).agg(F.collect_list("cell").alias("cells")).join(vectors, "query_id")  # a lot's cells
        both = chosen.groupBy("lot").cogroup(wanted.groupBy("lot"))
        return both.applyInArrow(lambda a, b: _score(a, b, k, mean), "query_id long, doc_id long, score double")

    early = scratch.cut(scored(first))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floors = early.withColumn("place", place).where((F.col("place") == k) & (F.col("score") > 0)).select("query_id", F.col("score").alias("floor"))
    reach = F.col("floor").isNull() | (F.col("bound") + 1e-6 >= F.col("floor"))
    later = scratch.cut(bounds.join(first.select("query_id", "cell"), ["query_id", "cell"], "left_anti").join(floors, "query_id", "left").where(reach))
    hits = scratch.cut(early.unionByName(scored(later)))
    if read is not None:
        count = lambda df: df.agg(F.sum("blocks")).first()[0] or 0
        read.update(blocks=count(bounds), read=count(first) + count(later))
    own = hits.groupBy("query_id").agg(F.count_if(F.col("score") > 0).alias("above"), F.count(F.lit(1)).alias("n"))
    short = weighted.select("query_id").distinct().join(own, "query_id", "left").where(F.coalesce("above", F.lit(0)) < k)
    most = short.agg(F.count(F.lit(1)), F.max(F.coalesce("n", F.lit(0)))).first()
    if most[0]:
        rest = cells.select(F.explode("ids").alias("id")).where(F.col("id").isNotNull()).orderBy("id").limit(k + most[1]).collect()
        lists = short.select("query_id", F.explode(F.array(*[F.lit(r.id) for r in rest]).cast("array<long>")).alias("doc_id"))
        hits = hits.unionByName(lists.join(hits, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    ranked = hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "doc_id", F.round("score", 6).alias("score"))
    return scratch.cut(ranked)  # so that what is joined to it, such as whole texts, need not be shuffled
