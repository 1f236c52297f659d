"""Exact n-gram Jaccard join by grouped prefixes.

A document is the set of its shingles; two link when their Jaccard similarity reaches num/den. Under one order
of all shingles, two linked sets of sizes m >= n share a shingle among the first n - ceil(t n) + 1 of each. The
order puts shingles met in many prefixes last, by their counts, and the others by hash; any order is exact, this
one keeps the lists of a shingle short.

1. Count the shingles of hash-ordered prefixes over all documents; the commonest ones, at most HOT, form the order.
2. Give each document its set's digest, its prefix and a bit signature. Equal sets become one class; classes of
   equal prefix and size become one group, and only groups enter the lists of prefix shingles. A group has the
   signature of one class and the bits in which all its classes agree.
3. Cheap links: each group is paired with one pivot group of its lists. Group pairs are filtered by size and the
   agreed bits of both; those left are expanded to classes, which are verified against the pivot's first class, as
   the classes of a group are against its first.
4. What is still apart: in each list the groups that hold different components are compared in place, again by
   size and agreed bits. First each group of a long list outside its largest component brings only its nearest such
   partner; then all that can still link. The pairs left are expanded: two groups of one class each are a pair of
   classes, larger ones are compared in place by the signatures of their classes, as are the classes of a group that
   holds several components. Pairs of classes are verified on whole sets. Pairs already in one component need no
   verification, so large groups of copies cost rows in proportion. Long lists are dealt out in pairs of blocks.

Signatures bound the overlap from above (each bit is the parity of the shingles that hash to it), so the filter
loses no link. Verification fetches whole sets for candidate classes only, chosen by a Bloom filter that grows with
their number up to MOST_BLOOM_BITS; what it lets through beyond them is dropped by the join.

Defined cases: null and wordless texts have no shingles and link with nothing; with fewer words than k the
whole sequence is one shingle; equal and repeated rows are linked if they have words; rows of one id with different
texts are documents of their own, each with its own size and component; a null id takes no part in links and has no
component; empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm import workers
from kelpline.llm.components import connected
from kelpline.llm.textcore import mix, shingle_sets
from kelpline.session import Scratch, cut, prepare

NUM, DEN = 80, 100
HOT = 1 << 19  # shingles of the order that are sent to all tasks: 8 MB at most
HOT_LEAST = 4  # prefixes that hold a shingle before it counts as common
BITS = 1024
LEAST_BLOOM_BITS, MOST_BLOOM_BITS = 1 << 20, 1 << 27  # 16 MB at most go to all tasks
BLOCK = 1024  # groups or classes of a list that are compared with as many others at once
SHORT = 16  # lists up to this long are compared many at a time
PAIRS = 1 << 18  # that a task gathers before it hands them on


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1 if n else 0


WORDS = BITS // 64


def _signature(own: np.ndarray) -> np.ndarray:
    bits = np.bincount((mix(own) >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _ordered_prefix(own: np.ndarray, hot: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The first *length* of the sorted set *own*: uncommon ones by hash, then common ones by count and hash."""
    if not len(hot):
        return own[:length]
    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
    weight = np.where(hot[at] == own, counts[at], 0)
    return own[np.argsort(weight, kind="stable")][:length]


def _list(arrays: list[np.ndarray | None]) -> pa.ListArray:
    """Lists of 64 bits each, None as null."""
    lengths = [0 if own is None else len(own) for own in arrays]
    missing = np.array([own is None for own in arrays] + [False])
    ends = pa.array(np.cumsum([0, *lengths]).astype(np.int32), mask=missing)
    values = np.concatenate([np.zeros(0, np.uint64), *(own for own in arrays if own is not None)]).view(np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(values))


def common_shingles(texts: DataFrame, scratch: Scratch, k: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) of those in at least HOT_LEAST hash-ordered prefixes, the commonest if there are too many."""

    @workers.task
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [own[: prefix_length(len(own), num, den)] for _, own in shingle_sets(batch.column("text"), k)]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["shingle"])

    counts = texts.mapInArrow(prefixes, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_LEAST)
    counts = scratch.cut(counts)
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()  # 64 at most
    least, total = HOT_LEAST, 0
    for step in sorted(steps, key=lambda r: -r.step):
        total += step.rows
        if total > HOT:
            least = 2 ** (step.step + 1)
            break
    table = counts.where(F.col("n") >= least).toArrow()
    shingles, n = table.column("shingle").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def describe(texts: DataFrame, hot: np.ndarray, counts: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(real, other, id, n, digest, head, signature, prefix) of every text; those without words or without an id have
    no prefix. ``id`` is the id until texts of one id turn out to differ, ``other`` then tells them apart."""
    sent = texts.sparkSession.sparkContext.broadcast((hot, counts))  # HOT bounds it

    @workers.task
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column("id").is_valid().to_pylist()
            sizes, digests, heads, signatures, prefixes = [], [], [], [], []
            for row, own in shingle_sets(batch.column("text"), k):
                sizes.append(len(own))
                if not len(own) or not named[row]:
                    for column in (digests, heads, signatures, prefixes):
                        column.append(None)
                    continue
                prefix = _ordered_prefix(own, *sent.value, prefix_length(len(own), num, den))
                digests.append(np.array([mix(own).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(own ^ np.uint64(0x5DEECE66D)))], np.uint64).tobytes())
                heads.append(np.array([mix(prefix + np.uint64(9)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(prefix))], np.uint64).tobytes())
                signatures.append(_signature(own))
                prefixes.append(prefix)
            columns = [batch.column("id"), batch.column("other"), batch.column("id"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(heads, pa.binary()), _list(signatures), _list(prefixes)]
            yield pa.RecordBatch.from_arrays(columns, ["real", "other", "id", "n", "digest", "head", "signature", "prefix"])

    return texts.mapInArrow(described, "real long, other long, id long, n int, digest binary, head binary, signature array<long>, prefix array<long>")


def _may_link(sig_a: np.ndarray, n_a: np.ndarray, sig_b: np.ndarray, n_b: np.ndarray, num: int, den: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(whether sizes and signatures leave room for a link, bits apart) of aligned or broadcast pairs; of the bits only
    the *known* ones count, if given."""
    differ = sig_a ^ sig_b
    apart = np.bitwise_count(differ if known is None else differ & known).sum(-1).astype(np.int64)
    total = n_a + n_b
    most = np.minimum((total - apart) // 2, np.minimum(n_a, n_b))
    return den * most >= num * (total - most), apart


def _longs(column: pa.Array) -> np.ndarray:
    """Rows of WORDS longs; null ones, signatures of which all is agreed, are all ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.full((len(column), WORDS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
    return out


def _bloom_hashes(column: str) -> list:
    return [F.xxhash64(F.col(column), F.lit("bloom")).alias("h0"), F.xxhash64(F.lit("bloom"), F.col(column)).alias("h1")]


def bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of *bits*, a power of two, over the column ``id``, in 64-bit words; only its words come to the driver."""
    mask = F.lit(bits - 1)
    places = F.array(*[F.shiftrightunsigned(h, s).bitwiseAND(mask) for h in ("h0", "h1") for s in (0, 32)])
    words = ids.select(*_bloom_hashes("id")).select(F.explode(places).alias("place"))
    table = words.groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _in_bloom(words: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    found = np.ones(batch.num_rows, bool)
    for name in ("h0", "h1"):
        h = batch.column(name).to_numpy().view(np.uint64)
        for s in (0, 32):
            place = (h >> np.uint64(s)) & np.uint64(64 * len(words) - 1)
            found &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def verify(texts: DataFrame, pairs: DataFrame, scratch: Scratch, k: int, num: int, den: int) -> DataFrame:
    """The (a, b) of *pairs* whose whole sets link. Each pair is checked beside its pivot *a*'s set."""
    total = pairs.count()
    if not total:
        return pairs.select("a", "b")
    size = min(MOST_BLOOM_BITS, max(LEAST_BLOOM_BITS, 1 << (32 * total).bit_length()))
    bits = texts.sparkSession.sparkContext.broadcast(bloom(pairs.select(F.explode(F.array("a", "b")).alias("id")), size))

    @workers.task
    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_in_bloom(bits.value, batch)))
            if batch.num_rows:
                held = [own.tobytes() for _, own in shingle_sets(batch.column("text"), k)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held, pa.binary())], ["id", "own"])

    sets = texts.select("id", "text", *_bloom_hashes("id")).mapInArrow(fetched, "id long, own binary")
    # A pivot's partners are dealt over salts of about 64, its own set going to each, ahead of theirs.
    salts = scratch.cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 64).cast("int").alias("salts")))
    salted = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.explode(F.array("a", "b")).alias("id"))
    dealt = salted.distinct().join(sets, "id").select("a", "salt", (F.col("id") != F.col("a")).alias("partner"), "id", "own")
    ordered = dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", "partner", "id")

    @workers.task
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, of, last = None, None, None  # one set is held, whatever the number of its partners and of rows of one id
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, salt, partner, i, own in zip(*(batch.column(c) for c in ("a", "salt", "partner", "id", "own"))):
                a, group, i = a.as_py(), (a.as_py(), salt.as_py()), i.as_py()
                if not partner.as_py():
                    if group != of:
                        pivot, of, last = np.frombuffer(own.as_py(), np.uint64), group, None
                    continue
                if i == last:  # a row of an id that is stored again
                    continue
                last, own = i, np.frombuffer(own.as_py(), np.uint64)
                both = len(np.intersect1d(pivot, own, assume_unique=True))
                if den * both >= num * (len(pivot) + len(own) - both):
                    out.append((a, i))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return ordered.mapInArrow(checked, "a long, b long").distinct()


def similar_documents(docs: DataFrame, k: int = 5, num: int = NUM, den: int = DEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; links join Jaccard similarities of num/den and more."""
    found = _similar(docs, k, num, den, key, text)
    return found.select(F.col("real").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")


def _similar(docs: DataFrame, k: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """(real, other, n, component_id) of every row, stored."""
    prepare(docs.sparkSession)
    whole = F.col(text).cast("string")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(key).cast("long"), whole).alias("other"), whole.alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        return _joined(texts, scratch, k, num, den)


def _joined(texts: DataFrame, scratch: Scratch, k: int, num: int, den: int) -> DataFrame:
    keep = scratch.cut
    named = texts.where(F.col("id").isNotNull())
    described = keep(describe(texts, *common_shingles(named, scratch, k, num, den), k, num, den))
    worded = described.where(F.col("digest").isNotNull())
    # Texts of one id that differ get ids of their own inside the join.
    several = keep(worded.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where(F.col("low") != F.col("high")).select(F.col("id").alias("many")))
    if not several.isEmpty():
        apart = lambda rows: rows.join(several, F.col("id") == F.col("many"), "left").withColumn("id", F.when(F.col("many").isNotNull(), F.col("other")).otherwise(F.col("id"))).drop("many")
        worded, named = keep(apart(worded)), apart(named)
    # Classes of equal sets, then groups of classes of equal prefix and size.
    classes = keep(worded.groupBy("n", "digest").agg(F.min("id").alias("class"), F.min("real").alias("least"), F.min("head").alias("head"), F.min("signature").alias("signature")))
    groups = keep(classes.groupBy("n", "head").agg(F.min("class").alias("group"), F.count(F.lit(1)).alias("classes")))
    grouped = keep(classes.join(groups, ["n", "head"]).select("class", "least", "n", "signature", "group", "classes"))
    units = keep(_group_units(grouped))
    lists = keep(_lists(worded, units, scratch))
    links = keep(verify(named, _tied(lists, units, grouped, scratch, num, den), scratch, k, num, den))
    parts = _components(grouped, links, scratch)
    checked = None
    for nearest in (True, False):
        pairs = _apart_classes(lists, units, grouped, parts, nearest, scratch, num, den)
        if pairs is None:
            break
        pairs = checked = keep(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"))
        links = keep(links.union(verify(named, pairs, scratch, k, num, den)))
        parts = _components(grouped, links, scratch)
    # Inner ids end here: a component is named by the least real id of its documents.
    placed = keep(grouped.select("class", "least").join(parts, "class"))
    ends = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = keep(placed.join(ends, "component").select("class", "component_id"))
    by_set = classes.select("n", "digest", "class").join(by_class, "class").select(F.col("n").alias("set_n"), F.col("digest").alias("set_digest"), "component_id")
    found = described.join(by_set, (F.col("n") == F.col("set_n")) & (F.col("digest") == F.col("set_digest")), "left")
    return cut(found.select("real", "other", "n", F.coalesce("component_id", "real").alias("component_id")))


def _group_units(grouped: DataFrame) -> DataFrame:
    """(unit, n, classes, signature, known): a group, the signature of one of its classes and the bits in which all of
    them agree, null if it has one class only."""
    bits = [F.element_at("signature", i + 1) for i in range(WORDS)]
    agreed = F.array(*[F.bitwise_not(F.bit_and(b).bitwiseXOR(F.bit_or(b))) for b in bits])
    several = grouped.where(F.col("classes") > 1).groupBy(F.col("group").alias("of")).agg(agreed.alias("known"))
    first = grouped.where(F.col("class") == F.col("group")).select(F.col("group").alias("unit"), "n", "classes", "signature")
    return first.join(several, F.col("unit") == F.col("of"), "left").drop("of")


def _lists(worded: DataFrame, units: DataFrame, scratch: Scratch) -> DataFrame:
    """(list, unit): the groups that hold a shingle in their prefix, for shingles of two groups and more."""
    one_each = worded.join(units.select(F.col("unit").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    met = scratch.cut(one_each.select(F.explode("prefix").alias("list"), F.col("id").alias("unit")))
    several = met.groupBy("list").agg(F.count(F.lit(1)).alias("units")).where(F.col("units") > 1)  # counted apart, as one shingle may be in most
    return met.join(several.select("list"), "list", "left_semi")


def _filtered(pairs: DataFrame, units: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of units that may link, with whether one of them has several classes."""
    one = units.select(F.col("unit").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("sig_a"), F.col("known").alias("known_a"), F.col("classes").alias("m_a"))
    two = units.select(F.col("unit").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("sig_b"), F.col("known").alias("known_b"), F.col("classes").alias("m_b"))
    met = pairs.join(one, "a").join(two, "b").where((den * F.col("n_a") >= num * F.col("n_b")) & (den * F.col("n_b") >= num * F.col("n_a")))
    met = met.select("a", "b", ((F.col("m_a") > 1) | (F.col("m_b") > 1)).alias("several"), "n_a", "n_b", "sig_a", "sig_b", "known_a", "known_b")

    @workers.task
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
                known = _longs(batch.column("known_a")) & _longs(batch.column("known_b"))
                ok, _ = _may_link(_longs(batch.column("sig_a")), n_a, _longs(batch.column("sig_b")), n_b, num, den, known)
                yield batch.filter(pa.array(ok)).select(["a", "b", "several"])

    return met.mapInArrow(possible, "a long, b long, several boolean")


def _class_units(grouped: DataFrame) -> DataFrame:
    """Each class as a unit of its own."""
    return grouped.select(F.col("class").alias("unit"), "n", F.lit(1).cast("long").alias("classes"), "signature", F.lit(None).cast("array<long>").alias("known"))


def _tied(lists: DataFrame, units: DataFrame, grouped: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Pairs of a class and one pivot: of another group of its lists, and of its own group."""
    first = lambda c: F.struct(F.xxhash64(c).alias("luck"), F.col(c).alias("unit"))
    pivots = scratch.cut(lists.groupBy("list").agg(F.min(first("unit")).alias("pivot")))
    chosen = lists.join(pivots, "list").groupBy("unit").agg(F.min("pivot").alias("pivot"))
    pairs = chosen.select(F.col("unit").alias("a"), F.col("pivot.unit").alias("b")).where(F.col("a") != F.col("b"))
    passed = scratch.cut(_filtered(pairs, units, num, den))
    alone = passed.where(~F.col("several")).select("a", "b")
    # Expanded: every class of the group with the pivot's first class, and with its own group's first class.
    outer = passed.where("several").join(grouped.select(F.col("group").alias("a"), "class"), "a").select("class", F.col("b").alias("pivot"))
    inner = grouped.where(F.col("class") != F.col("group")).select("class", F.col("group").alias("pivot"))
    expanded = outer.union(inner).select(F.col("class").alias("a"), F.col("pivot").alias("b"))
    checked = _filtered(expanded, _class_units(grouped), num, den).select("a", "b")
    both = alone.union(checked)
    return scratch.cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _mixed(lists: DataFrame, state: DataFrame, scratch: Scratch) -> DataFrame:
    """(list, unit, component, mixed, m) of the *lists* (list, unit) that hold several components; m is a list's length.

    *state*: (unit, low, high), the least and the greatest component of its classes.
    """
    placed = scratch.cut(lists.join(state, "unit"))
    sizes = placed.groupBy("list").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count(F.lit(1)).alias("m"))
    wanted = scratch.cut(sizes.where(F.col("least") < F.col("most")).select("list", "m"))
    return scratch.cut(placed.join(wanted, "list").select("list", "unit", F.col("low").alias("component"), (F.col("low") < F.col("high")).alias("mixed"), "m"))


def _apart_classes(lists: DataFrame, units: DataFrame, grouped: DataFrame, parts: DataFrame, nearest: bool, scratch: Scratch, num: int, den: int) -> DataFrame | None:
    """Pairs a < b of classes of different components that may link; None if all lists and groups are of one component."""
    state = scratch.cut(grouped.select("class", "group").join(parts, "class"))
    by_group = state.groupBy(F.col("group").alias("unit")).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    by_class = state.select(F.col("class").alias("unit"), F.col("component").alias("low"), F.col("component").alias("high"))
    open_lists = _mixed(lists, by_group, scratch)
    own = scratch.cut(by_group.where(F.col("low") < F.col("high")).select(F.col("unit").alias("group")))
    met = None if open_lists.isEmpty() else scratch.cut(_apart(open_lists, units, nearest, num, den))
    inside = not own.isEmpty()
    if met is None and not inside:
        return None
    size = units.select(F.col("unit").alias("of"), "classes")
    found, expanded = None, []
    if met is not None:
        sized = met.join(size.withColumnsRenamed({"of": "a", "classes": "m_a"}), "a").join(size.withColumnsRenamed({"of": "b", "classes": "m_b"}), "b")
        sized = scratch.cut(sized)
        one = (F.col("m_a") == 1) & (F.col("m_b") == 1)
        found = sized.where(one).select("a", "b")
        larger = sized.where(~one)
        if not larger.isEmpty():
            ends = larger.select(F.xxhash64("a", "b").alias("list"), F.explode(F.array("a", "b")).alias("group"))
            expanded.append(ends.join(grouped.select("group", F.col("class").alias("unit")), "group").select("list", "unit"))
    if inside:
        expanded.append(own.join(grouped.select("group", F.col("class").alias("unit")), "group").select(F.xxhash64("group", F.lit("group")).alias("list"), "unit"))
    for rows in expanded:
        more = _apart(_mixed(rows, by_class, scratch), _class_units(grouped), nearest, num, den)
        found = more if found is None else found.union(more)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(left: DataFrame, units: DataFrame, nearest: bool, num: int, den: int) -> DataFrame:
    """Pairs a < b of units of a list that hold different components and may link.

    Lists are compared in place, whole or in pairs of blocks. With *nearest*, each unit of a long list outside
    the largest component of its block brings its nearest partner only.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = left.join(units.select("unit", "n", "signature", "known"), "unit").withColumn("block", F.pmod(F.xxhash64("unit"), blocks).cast("int"))
    own = F.col("block")
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("list", F.least(own, "o").alias("i"), F.greatest(own, "o").alias("j"), "unit", "component", "mixed", "n", "signature", "known")
    dealt = rows.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "component", "unit")

    def compare(component, mixed, unit, n, signature, known) -> Iterator[np.ndarray]:
        marks, counts = np.unique(component, return_counts=True)
        rest = np.flatnonzero((component != marks[np.argmax(counts)]) | mixed)
        step = max(1, (1 << 22) // (len(unit) * WORDS))
        for start in range(0, len(rest), step):
            some = rest[start : start + step]
            mask = None if known is None else known[some][:, None] & known[None]
            ok, apart = _may_link(signature[some][:, None], n[some][:, None], signature[None], n[None], num, den, mask)
            ok &= (component[some][:, None] != component[None]) | mixed[some][:, None] | mixed[None]
            ok[np.arange(len(some)), some] = False
            if nearest:
                best = np.argmin(np.where(ok, apart, 1 << 30), axis=1)
                found = ok[np.arange(len(some)), best]
                yield np.stack([unit[some][found], unit[best][found]])
            else:
                x, y = np.nonzero(ok)
                yield np.stack([unit[some][x], unit[y]])

    @workers.task
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs_of(table: pa.Table) -> Iterator[np.ndarray]:
            """All groups of rows of *table*, which are whole: short lists at once, long ones each."""
            keys = np.stack([table.column(c).to_numpy() for c in ("list", "i", "j")])
            bounds = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [table.num_rows]])
            component, unit, n = (table.column(c).to_numpy().astype(np.int64) for c in ("component", "unit", "n"))
            mixed = table.column("mixed").to_numpy(zero_copy_only=False).astype(bool)
            signature = _longs(table.column("signature"))
            known = _longs(table.column("known")) if table.column("known").null_count < table.num_rows else None
            length = np.diff(bounds)
            group, short = np.repeat(np.arange(len(length)), length), np.repeat(length <= SHORT, length)
            for step in range(1, min(SHORT, len(unit))):
                differ = (component[:-step] != component[step:]) | mixed[:-step] | mixed[step:]
                at = np.flatnonzero(short[:-step] & (group[:-step] == group[step:]) & differ)
                ok, _ = _may_link(signature[at], n[at], signature[at + step], n[at + step], num, den, None if known is None else known[at] & known[at + step])
                yield np.stack([unit[at[ok]], unit[at[ok] + step]])
            for g in np.flatnonzero(length > SHORT):
                a, b = bounds[g], bounds[g + 1]
                yield from compare(component[a:b], mixed[a:b], unit[a:b], n[a:b], signature[a:b], None if known is None else known[a:b])

        def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
            gathered, size = [], 0
            for pairs in pairs_of(table):
                gathered.append(np.sort(pairs, axis=0))
                size += pairs.shape[1]
                if size > PAIRS:
                    yield _pairs(gathered)
                    gathered, size = [], 0
            if size:
                yield _pairs(gathered)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            last = [table.column(c)[-1].as_py() for c in ("list", "i", "j")]
            keys = np.stack([table.column(c).to_numpy() for c in ("list", "i", "j")])
            going = int(np.argmax((keys == np.array(last)[:, None]).all(0)))  # the last group may go on in the next batch
            if going:
                yield from close(table.slice(0, going))
            held = table.slice(going).to_batches()
        if held:
            yield from close(pa.Table.from_batches(held))

    return dealt.mapInArrow(compared, "a long, b long").distinct()


def _pairs(gathered: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(gathered, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _components(grouped: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    found = connected(links, scratch).select("node", F.col("component").alias("least"))
    return scratch.cut(grouped.select("class").join(found, F.col("class") == F.col("node"), "left").select("class", F.coalesce("least", "class").alias("component")))


def one_of_each(docs: DataFrame, k: int = 5, num: int = NUM, den: int = DEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of *docs* whose id is the least of its component, one row for each text of an id; rows without an id stay. Of
    several rows of an id and a text the one whose other columns, as JSON, are least is kept. All columns stay, whatever their names."""
    marked = _similar(docs, k, num, den, key, text).where(F.col("real") == F.col("component_id")).groupBy("real", "other").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(key).cast("long").alias("id"), F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")).alias("mark"))
    marked = cut(marked)
    met = lambda kept: rows.join(kept, (F.col("id") == F.col("real")) & (F.col("mark") == F.col("other")), "left_semi")
    kept = met(marked.where(~F.col("repeated")))
    again = marked.where("repeated")
    if not again.isEmpty():
        told = F.to_json(F.struct(*[F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c not in (key, text)], F.lit(0).alias("c")))
        place = F.row_number().over(Window.partitionBy("id", "mark").orderBy("told"))
        kept = kept.unionByName(met(again).withColumn("told", told).withColumn("place", place).where(F.col("place") == 1).drop("told", "place"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names]).unionByName(docs.where(F.col(key).isNull()))
