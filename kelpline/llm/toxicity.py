"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words that mark labelled toxic texts is learned from document counts by label. Each text becomes
a dense vector: lexicon densities, second-person words near lexicon words, capitals, punctuation and
obfuscation rates. Small boosted trees are fitted to the labels with logistic loss; their margins are mapped to
frequencies by isotonic regression on rows that neither the lexicon nor the trees have seen.

The classifier is fitted on a sample of labelled rows bounded by ``fit_rows``, chosen by a hash of the id.

Defined cases: null and empty texts have the vector of an empty text and get a score like any other; labels
that are null or neither 0 nor 1, and rows with a null id, are not learned from; several labels of one id count
as their maximum; without toxic or without other labels every score is the share of toxic ones; repeated rows
get equal scores; empty tables give none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm import workers
from kelpline.llm.langid import least_by_hash, remainder
from kelpline.llm.textcore import LOWER, SPACE, parts, span_hashes
from kelpline.session import prepare

LEXICON_SIZE, LEAST_DOCS, LEAST_Z = 400, 4, 3.5
NEAR = 5  # words
SECOND_PERSON = "you your yours yourself youre du dich dir dein deine ihr euch euer tu te ti tus tuyo toi ton ta tes vous votre vos usted ustedes tú".split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DIGIT, _UPPER, _POINT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_DIGIT[0x30:0x3A] = True
_UPPER[0x41:0x5B] = True
_POINT[[ord(c) for c in "!?"]] = True
_SYMBOL[[ord(c) for c in "*@$#%&+_"]] = True


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, per-row bounds) of runs of letters and digits."""
    n = len(data)
    inside = _LETTER[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]])[:n] | cut[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]])[:n] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(span_hashes(data, np.concatenate([[0], ends[:-1]]), ends))


_YOU = _hash_words(SECOND_PERSON)


def _find(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in *sorted_keys*, or -1."""
    if not len(sorted_keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == values, at, -1)


def features(column: pa.Array, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One dense row per text. *lexicon*: sorted word hashes; *weights*: their log-odds."""
    blocks = []
    for _, _, data, offsets in parts(column):
        starts, ends, bounds = _tokens(data, offsets)
        hashes = span_hashes(LOWER[data], starts, ends)
        hit = _find(lexicon, hashes)
        you = _find(_YOU, hashes) >= 0
        marked = hit >= 0
        weight = np.where(marked, weights[hit], 0.0) if len(weights) else np.zeros(len(hit))
        around = np.concatenate([[0], np.cumsum(you)])
        place = np.arange(len(hit))
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        low, high = np.maximum(place - NEAR, bounds[row_of]), np.minimum(place + NEAR + 1, bounds[row_of + 1])
        near = marked & (around[high] > around[low])

        def total(values, at):
            sums = np.concatenate([[0.0], np.cumsum(values)])
            return sums[at[1:]] - sums[at[:-1]]

        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        inner = digits[ends] - digits[starts]
        mixed = (inner > 0) & (inner < ends - starts)
        word_inside = ~SPACE[data]
        symbol = _SYMBOL[data]
        if len(data) > 2:
            between = np.zeros(len(data), bool)
            between[1:-1] = _LETTER[data[:-2]] & _LETTER[data[2:]]
            symbol = symbol & between
            repeat = np.zeros(len(data), bool)
            repeat[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
        else:
            repeat = symbol = np.zeros(len(data), bool)
        count, size = np.maximum(np.diff(bounds), 1), np.maximum(np.diff(offsets), 1)
        hits, force = total(marked, bounds), total(weight, bounds)
        most = np.zeros(len(offsets) - 1)
        np.maximum.at(most, row_of, weight)
        blocks.append(np.column_stack([
            hits / count, force / count, np.log1p(hits), np.log1p(np.maximum(force, 0)), most,
            total(near, bounds) / count, total(you, bounds) / count, np.log1p(total(near, bounds)),
            total(_UPPER[data], offsets) / size, total(_POINT[data], offsets) / size,
            total(word_inside & ~_LETTER[data], offsets) / size,
            total(mixed, bounds) / count, total(symbol, offsets) / size, total(repeat, offsets) / size,
            np.log1p(np.diff(bounds)),
        ]))
    return np.concatenate(blocks) if blocks else np.zeros((0, 15))


@dataclass
class Trees:
    """Boosted trees of fixed depth; node i has children 2i+1 and 2i+2."""

    base: float
    split_feature: np.ndarray  # trees x inner nodes
    split_value: np.ndarray
    leaves: np.ndarray  # trees x leaves

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.split_feature.shape[1]
        rows = np.arange(len(x))
        for f, v, leaf in zip(self.split_feature, self.split_value, self.leaves):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > v[node])
            out += leaf[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0) -> Trees:
    """Histogram gradient boosting with logistic loss."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    rate_of_one = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    margin = np.full(len(y), base)
    inner = 2**depth - 1
    all_f, all_v, all_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        f, v, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**depth)
        node = np.zeros(len(y), np.int64)
        for i in range(inner):
            own = np.flatnonzero(node == i)
            best = 1e-6
            for j, e in enumerate(edges):
                if not len(e) or not len(own):
                    continue
                g = np.bincount(binned[own, j], grad[own], len(e) + 1)
                h = np.bincount(binned[own, j], hess[own], len(e) + 1)
                gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
                gr, hr = g.sum() - gl, h.sum() - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, f[i], v[i] = gain[k], j, e[k]
            node[own] = 2 * i + 1 + (x[own, f[i]] > v[i])
        sums, weights = np.bincount(node - inner, grad, 2**depth), np.bincount(node - inner, hess, 2**depth)
        leaf = rate * sums / (weights + ridge)
        margin += leaf[node - inner]
        all_f.append(f), all_v.append(v), all_l.append(leaf)
    return Trees(base, np.array(all_f), np.array(all_v), np.array(all_l))


def isotonic(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: (centres of the pools, their frequencies), both rising."""
    order = np.argsort(margins, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of margins
    for m, t in zip(margins[order], y[order]):
        pools.append([float(t), 1.0, float(m)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class Model:
    lexicon: np.ndarray
    weights: np.ndarray
    trees: Trees | None
    centres: np.ndarray
    levels: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.levels[0])
        margins = self.trees.margins(features(column, self.lexicon, self.weights))
        level = np.interp(margins, self.centres, self.levels)
        # Within a level the margin still orders the texts, by less than the levels differ.
        return np.clip(0.998 * level + 0.002 / (1 + np.exp(-margins)), 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, fit_rows: int = 12_000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on at most ``fit_rows`` labelled ids, the least by a hash, for which *learnable* (an expression of ``id``) holds."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & learnable)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    sample = least_by_hash(known, F.col("id"), "toxicity", known.count(), fit_rows)
    picked = F.broadcast(sample)  # fit_rows at most
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(picked, "id").select("id", "text", "y")
    # A quarter of the sample, by a hash of the id, is kept for calibration, unless a part would lack a class.
    kept = F.shiftright(F.crc32(F.encode(F.concat(F.lit("calibration "), F.col("id").cast("string")), "utf-8")), 3) % 4 == 0
    tally = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy(kept.alias("fold"), "y").count().collect()}  # four at most
    fold = kept if len(tally) == 4 else F.lit(False)

    @workers.task
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for first, _, data, offsets in parts(batch.column("text")):
                starts, ends, bounds = _tokens(data, offsets)
                hashes = span_hashes(LOWER[data], starts, ends)
                own = [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
                marks = np.repeat(y[first : first + len(own)], [len(o) for o in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(marks.astype(np.int32))], ["word", "y"])

    counts = rows.where(~fold).mapInArrow(words, "word long, y int").groupBy("word").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n"))
    learned = {k: n for k, n in tally.items() if len(tally) < 4 or not k[0]}
    ones, n = sum(c for (_, y), c in learned.items() if y), sum(learned.values())
    if not ones or ones == n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), None, np.zeros(1), np.array([ones / n if n else 0.0]))
    rate = ones / n
    z = (F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    top = counts.where((F.col("n") >= LEAST_DOCS) & (z > LEAST_Z)).select("word", "toxic", "n").orderBy(z.desc(), "word").limit(LEXICON_SIZE).collect()
    top.sort(key=lambda r: np.int64(r.word).view(np.uint64))
    lexicon = np.array([r.word for r in top], np.int64).view(np.uint64)
    weights = np.array([np.log((r.toxic + 0.5) / (r.n - r.toxic + 0.5)) - np.log(rate / (1 - rate)) for r in top])

    @workers.task
    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"), lexicon, weights)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("fold"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "fold", "x"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, y int, fold boolean, x array<double>"
    fitted = rows.withColumn("fold", fold).mapInArrow(dense, schema).collect()  # fit_rows ids
    fitted.sort(key=lambda r: (str(r.id), r.x))
    x, y = np.array([r.x for r in fitted]).reshape(len(fitted), -1), np.array([r.y for r in fitted], float)
    held = np.array([r.fold for r in fitted], bool)
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:  # as the labelled texts are, which may be fewer than the labels
        if len({*y}) < 2:
            return Model(lexicon, weights, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
        held = np.ones(len(y), bool)
        trees = boost(x, y)
    else:
        trees = boost(x[~held], y[~held])
    centres, levels = isotonic(trees.margins(x[held]), y[held])
    return Model(lexicon, weights, trees, centres, levels)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row; the model's size is fixed by LEXICON_SIZE and the trees."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))

    @workers.task
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(batch.column("text")))], ["id", "score"])

    return rows.mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", key)


def held_out(key: Column, parts_: int, part: int) -> Column:
    return F.coalesce(remainder(key, parts_) == part, F.lit(False))
