"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule: the relative rate at which it is drawn as training time runs from 0
to 1, given by (time, rate) points joined by straight lines. The weights give each source a target of words,
capped at ``max_epochs`` times its own, the excess going to the others. A source's documents lie in a fixed
order; their words, laid end to end and repeated up to the target, are its demand. The integral of the
schedule says what part of the demand falls before any time; inverting it gives each document's position in
training for each of its passes. Sorting by position gives the order of training.

The last pass of a source may end inside a document: its first words are taken (``taken`` counts words), so a
source's taken words equal its target but for rounding. With ``whole=True`` a pass takes a document if its
middle word falls within the demand, so documents stay whole and a source misses its target by half a document.

Defined cases: a null text has size 0 and takes nothing; null sources are one source, last in order; documents
without words have a null position; ties and repeated rows each take their own place, in an order of their own
content, so reruns agree; an empty table gives none; other columns play no part. Columns of ``training_rows`` must
be of kinds that can be hashed (no maps); they may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.sharding import with_offsets
from kelpline.session import cut, prepare

WORD = r"[^\x20\x09-\x0D]+"
#: Rates at times; the k-th source in order of code points takes the k-th of these, repeating.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
WEIGHTS = (1.0, 2.0, 3.0)
MAX_SOURCES = 100_000


def water_fill(sizes: Sequence[int], weights: Sequence[float], max_epochs: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above max_epochs times its size, the excess reshared by weight."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        scale = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if scale * weights[i] > max_epochs * sizes[i]]
        for i in full or sorted(open_):
            targets[i] = float(max_epochs * sizes[i]) if full else scale * weights[i]
        if not full:
            break
        left -= sum(targets[i] for i in full)
        open_.difference_update(full)
    return targets


def inverse_demand(points: Sequence[tuple[float, float]], share: Column) -> Column:
    """The time by which *share* (0 to 1) of a schedule's integral has passed: a quadratic on each piece."""
    pieces, area = [], 0.0
    for (t0, r0), (t1, r1) in zip(points, points[1:]):
        pieces.append((t0, t1 - t0, r0, (r1 - r0) / (t1 - t0), area))
        area += (t1 - t0) * (r0 + r1) / 2
    out = None
    for t0, _, rate, slope, before in pieces:
        need = F.greatest(share * F.lit(area) - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(rate * rate) + F.lit(2 * slope) * need, F.lit(0.0)))
        # The stable form of the root holds for rising, level and falling rates alike.
        time = F.lit(t0) + 2 * need / (F.lit(rate) + root)
        out = time if out is None else F.when(share * F.lit(area) > F.lit(before), time).otherwise(out)
    return out


def demand(points: Sequence[tuple[float, float]], time: Column) -> Column:
    """The share (0 to 1) of a schedule's integral that has passed by *time*: the inverse of ``inverse_demand``."""
    area, total = F.lit(0.0), sum((t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(points, points[1:]))
    for (t0, r0), (t1, r1) in zip(points, points[1:]):
        inside = F.greatest(F.least(time - F.lit(t0), F.lit(t1 - t0)), F.lit(0.0))
        area = area + inside * (F.lit(r0) + F.lit((r1 - r0) / (t1 - t0) / 2) * inside)
    return area / F.lit(total)


def digest(columns: Sequence[str]) -> Column:
    """A 64-bit digest of a row's *columns*, nulls included."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def _mixed(rows: DataFrame, weights, schedules, max_epochs: int, whole: bool) -> tuple[DataFrame, list[float]]:
    """*rows* (id, origin, size, place, mark) with source_size, target, taken, passes and positions; the words that
    sources of each schedule take."""
    placed = with_offsets(cut(rows), ["origin", "place", "mark", "id"])
    totals = placed.groupBy("origin").agg(F.sum("size").alias("size"), F.min("start").alias("start")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: sources are configuration, each has a weight")
    totals.sort(key=lambda r: (r.origin is None, r.origin or ""))
    per = [weights[i % len(weights)] for i in range(len(totals))]
    targets = water_fill([r["size"] for r in totals], per, max_epochs)
    listed = [(r.origin, r["size"], r.start, t, i % len(schedules)) for i, (r, t) in enumerate(zip(totals, targets))]
    by_kind = [sum((x[3] for x in listed if x[4] == kind), 0.0) for kind in range(len(schedules))]
    known = rows.sparkSession.createDataFrame(listed, "known_origin string, source_size long, source_start long, target double, kind int")
    met = placed.join(F.broadcast(known), F.col("origin").eqNullSafe(F.col("known_origin")))  # MAX_SOURCES rows at most
    met = met.withColumn("begin", F.col("start") - F.col("source_start")).withColumn("wanted", F.round("target").cast("long"))
    passes = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    left = lambda k: F.col("wanted") - k * F.col("source_size") - F.col("begin")  # noqa: E731  demand from this document on
    if whole:
        got = lambda k: F.when(2 * left(k) > F.col("size"), F.col("size")).otherwise(F.lit(0))
    else:
        got = lambda k: F.greatest(F.least(left(k), F.col("size")), F.lit(0))
    used = F.filter(passes, lambda k: got(k) > 0)
    share = lambda k: (k * F.col("source_size") + F.col("begin")) / F.col("wanted")
    at = lambda k: F.element_at(F.array(*[inverse_demand(p, share(k)) for p in schedules]), F.col("kind") + 1)
    taken = F.aggregate(passes, F.lit(0).cast("long"), lambda acc, k: acc + got(k))
    mixed = met.select("id", "place", "mark", "size", "source_size", "target", taken.alias("taken"), F.size(used).alias("passes"), F.transform(used, at).alias("positions"))
    return mixed, by_kind


def place_of(key: str, text: str, source: str) -> Column:
    """The place of a document in its source's order: a digest that other engines can tell, too."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in (key, source, text)]
    return F.md5(F.encode(F.concat_ws("|", *told), "utf-8"))


def _sized(docs: DataFrame, key: str, text: str, source: str, mark: Column) -> DataFrame:
    return docs.select(
        F.col(key).alias("id"),
        F.col(source).cast("string").alias("origin"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        place_of(key, text, source).alias("place"),
        mark.alias("mark"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    max_epochs: int = 3,
    whole: bool = False,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(key, place, size, source_size, target, taken, passes, positions) of every row; ``place`` digests id, text and source.

    ``passes`` counts the passes that take any of the document, ``positions`` has the training position of
    each. Sources are configuration (each has a weight), so their totals, MAX_SOURCES rows at most, go to the driver.
    """
    prepare(docs.sparkSession)
    mixed, _ = _mixed(_sized(docs, key, text, source, digest([key, text, source])), weights, schedules, max_epochs, whole)
    return mixed.select(F.col("id").alias(key), "place", "size", "source_size", "target", "taken", "passes", "positions")


def training_rows(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    max_epochs: int = 3,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The rows of *docs*, whole, once per pass, range-sorted by training position.

    The mix is computed on digests and sizes. A partition is a stretch of training that holds an equal share of all
    words, so a position tells its partition without sampling: the schedules' demand by that time. Texts move
    twice: by digest, to meet the list of the partitions that take them, and to those partitions. Equal rows count
    as one text with the positions of all, told by partition, so no group of copies makes more rows than there
    are partitions. Rows that are equal in every column are interchangeable.
    """
    prepare(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    own = {c: f"c{i}" for i, c in enumerate(names)}
    place, mark = place_of(own[key], own[text], own[source]), digest(list(own.values()))
    mixed, words = _mixed(_sized(rows, own[key], own[text], own[source], mark), weights, schedules, max_epochs, True)
    passes = mixed.select("place", "mark", F.explode("positions").alias("position"))
    whole = sum(words) or 1.0
    passed = sum((F.lit(w / whole) * demand(p, F.round("position", 12)) for w, p in zip(words, schedules)), F.lit(0.0))
    part = F.least(F.floor(passed * parts), F.lit(parts - 1)).cast("int")
    wanted = cut(passes.withColumn("part", part).groupBy("place", "mark", "part").agg(F.array_sort(F.collect_list("position")).alias("positions")))
    texts = rows.withColumns({"place": place, "mark": mark})
    repeated = mixed.groupBy("place", "mark").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    if not repeated.isEmpty():
        texts = texts.dropDuplicates(["place", "mark"])
    met = texts.join(wanted.hint("shuffle_hash"), ["place", "mark"]).repartitionById(parts, "part")
    taken = met.select("*", F.explode("positions").alias("position")).sortWithinPartitions("position", "place", "mark")
    return taken.select(*[F.col(own[c]).alias(c) for c in names])


def documents_by_position(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document, range-sorted by the position of its first pass; those not taken come first."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = mixed.withColumn("position", F.try_element_at("positions", F.lit(1)))
    return rows.repartitionByRange(parts, "position", key).sortWithinPartitions("position", key)
