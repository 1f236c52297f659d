"""Language identification by the nearest of several centroids per language.

A text is the vector of its byte bigrams and trigrams (lower case, anything but letters as one space) hashed
to DIMENSIONS, weighted by log(1 + count) times inverse document frequency and brought to length one. Each
language has up to CLUSTERS centroids from spherical k-means, none for a few odd texts. The language of the centroid with the largest
cosine wins; a text whose cosine is far below those of the language's training texts, for its number of n-grams,
is rejected.

The classifier is fitted on a sample of labelled texts bounded by ``fit_per_language`` rows of each language,
chosen by a hash of the id.

Defined cases: null texts and texts without a letter get ``und`` with score 0 and are rejected; ties go to the
language first in order; null languages and null ids are never learned from; repeated rows get equal answers;
without anything to learn from every text gets ``und``; empty tables give none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm import workers
from kelpline.llm.textcore import parts
from kelpline.session import prepare

DIMENSIONS = 1 << 13
CLUSTERS = 3
ROUNDS = 12
LEAST_SHARE = 0.1
MOST_ROWS = 40_000  # that are learned from, of all languages together; each is a few kB on the driver
MOST_LANGUAGES = 1000
UNKNOWN = "und"
_SHIFT = np.uint32(32 - 13)
_LETTER_OR_SPACE = np.full(256, 0x20, np.uint8)
_LETTER_OR_SPACE[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER_OR_SPACE[0x80:] = np.arange(0x80, 0x100)


def vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, hashed n-grams in order, their counts)."""
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    padded = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), lower, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    for first, end, data, offsets in parts(padded):
        data = _LETTER_OR_SPACE[data].astype(np.uint32)
        two = data[:-1] << np.uint32(8) | data[1:]
        three = two[:-1] << np.uint32(8) | data[2:]
        two = (two + np.uint32(1)) * np.uint32(0x9E3779B1) >> _SHIFT
        three = (three + np.uint32(1 << 24)) * np.uint32(0x85EBCA77) >> _SHIFT
        for row in range(first, end):
            a, b = offsets[row - first], offsets[row - first + 1]
            counts = np.bincount(two[a : b - 1], minlength=DIMENSIONS)
            if b - a > 2:
                counts += np.bincount(three[a : b - 2], minlength=DIMENSIONS)
            found = np.flatnonzero(counts)
            yield row, found, counts[found]


def share(n: np.ndarray | int, full: float) -> np.ndarray:
    """How a text's cosine falls with its distinct n-grams, if they are fewer than *full*."""
    return np.sqrt(np.minimum(1.0, n / full))


@dataclass
class Classifier:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # DIMENSIONS x centroids
    idf: np.ndarray
    least: np.ndarray  # cosine at each centroid below which a text of *full* n-grams is rejected
    full: np.ndarray

    def weigh(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = np.log1p(counts) * self.idf[found]
        return values / (np.sqrt((values * values).sum()) or 1.0)

    def predict(self, found: np.ndarray, counts: np.ndarray) -> tuple[str, float, bool]:
        cosines = self.weigh(found, counts) @ self.centroids[found]
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(max(cosines[best], 0.0), 1.0)), bool(cosines[best] < self.least[best] * share(len(found), self.full[best]))


def cluster(rows: np.ndarray, k: int, rounds: int = ROUNDS, tries: int = 8, seed: int = 0) -> np.ndarray:
    """Unit centroids of spherical k-means from k-means++ seeds. A cluster of less than LEAST_SHARE of an even share is seeded anew, and in the end dropped."""
    draw = np.random.default_rng(seed)
    k = min(k, len(rows))
    least = LEAST_SHARE * len(rows) / k
    centroids = rows[draw.integers(len(rows))][None]
    for turn in range(tries):
        while len(centroids) < k:
            apart = np.maximum(1 - np.max(rows @ centroids.T, axis=1), 0).astype(float) + 1e-12
            centroids = np.concatenate([centroids, rows[draw.choice(len(rows), p=apart / apart.sum())][None]])
        for _ in range(rounds):
            near = np.argmax(rows @ centroids.T, axis=1)
            centroids = np.array([rows[near == c].mean(0) if (near == c).any() else centroids[c] for c in range(len(centroids))])
            centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        sizes = np.bincount(np.argmax(rows @ centroids.T, axis=1), minlength=k)
        if (sizes >= least).all():
            break
        centroids = centroids[sizes >= least]
    return centroids


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], slack: float = 0.4) -> Classifier | None:
    """*samples*: (language, n-grams, counts). ``slack``: part of the least training cosine of the language that is still accepted."""
    if not samples:
        return None
    samples = sorted(samples, key=lambda s: (s[0], len(s[1]), s[1].tolist(), s[2].tolist()))
    seen = np.zeros(DIMENSIONS)
    for _, found, _ in samples:
        seen[found] += 1
    model = Classifier([], np.zeros((DIMENSIONS, 0)), np.log((1 + len(samples)) / (1 + seen)) + 1.0, np.zeros(0), np.zeros(0))
    centroids, least, full = [], [], []
    for language in sorted({s[0] for s in samples}):
        own = [s for s in samples if s[0] == language]
        rows = np.zeros((len(own), DIMENSIONS), np.float32)
        for i, (_, found, counts) in enumerate(own):
            rows[i, found] = model.weigh(found, counts)
        made = cluster(rows, CLUSTERS)
        cosines = rows @ made.T
        near = np.argmax(cosines, axis=1)
        for c in range(len(made)):
            if (near == c).any():
                model.languages.append(language)
                centroids.append(made[c])
        # One bound per language, for a text of the median number of n-grams: shorter texts have smaller cosines.
        held = np.array([len(found) for _, found, _ in own])
        middle = max(float(np.median(held)), 1.0)
        least += [slack * float((cosines.max(1) / np.maximum(share(held, middle), 1e-12)).min())] * (len(model.languages) - len(least))
        full += [middle] * (len(model.languages) - len(full))
    model.centroids, model.least, model.full = np.array(centroids, np.float32).T.copy(), np.array(least), np.array(full)
    return model


def remainder(key: Column, parts_: int) -> Column:
    return F.crc32(F.encode(key.cast("string"), "utf-8")) % parts_


def hash_limit(total: int, wanted: int) -> int:
    """A bound on hashes of 64 bits, under which *wanted* of *total* keys fall with hardly any chance of fewer."""
    share = (wanted + 8 * wanted**0.5 + 8) / max(total, 1)
    return (1 << 63) - 1 if share >= 1 else int((2 * share - 1) * 2**63)


def least_by_hash(rows: DataFrame, key: Column, salt: str, total: int, wanted: int) -> DataFrame:
    """The *wanted* rows of *total* whose keys have the least hashes; the bound leaves few more to sort."""
    place = F.xxhash64(key, F.lit(salt))
    return rows.where(place <= hash_limit(total, wanted)).orderBy(place, key).limit(wanted)


def learn(docs: DataFrame, learnable: Column, fit_per_language: int = 400, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Classifier | None:
    """Fits on at most ``fit_per_language`` (with many languages fewer, MOST_ROWS in all) of the rows of each language for
    which *learnable* holds: those whose keys have the least hashes."""
    prepare(docs.sparkSession)
    rows = docs.where(learnable & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted_rows = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counted_rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    totals = {r["lang"]: r["count"] for r in counted_rows}
    if not totals:
        return None
    each = max(1, min(fit_per_language, MOST_ROWS // len(totals)))
    place = F.xxhash64(F.col("k"), F.lit("langid"))
    limits = F.create_map(*[F.lit(x) for name, n in totals.items() for x in (name, hash_limit(n, each))])
    few = rows.where(place <= limits[F.col("lang")]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(place, "k", "text")))
    picked = few.where(F.col("place") <= each).where(F.col("text").rlike(r"\p{L}"))

    @workers.task
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(vectors(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.list_(pa.int32()))],
                ["lang", "found", "counts"],
            )

    sample = picked.mapInArrow(counted, "lang string, found array<int>, counts array<int>").collect()
    return fit([(r.lang, np.array(r.found), np.array(r["counts"])) for r in sample])


def identify(docs: DataFrame, model: Classifier | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang_pred, score, rejected, *keep) of every row; the model is small: fixed DIMENSIONS, CLUSTERS per language."""
    prepare(docs.sparkSession)
    others = [c for c in keep if c not in (key, text)]
    rows = docs.select(
        F.col(key).alias("id"),
        F.col(text).cast("string").alias("text"),
        F.col(text).rlike(r"\p{L}").alias("lettered"),
        *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(others)],
    )
    dropped = ["lettered"] if text in keep else ["lettered", "text"]

    @workers.task
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch.column("lettered").to_pylist()
            answers = [(UNKNOWN, 0.0, True)] * batch.num_rows
            for row, found, counts in vectors(batch.column("text")) if model else ():
                if lettered[row]:
                    answers[row] = model.predict(found, counts)
            columns = [pa.array([a[i] for a in answers], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            rest = batch.drop_columns(dropped)
            yield pa.RecordBatch.from_arrays([*rest.columns, *columns], [*rest.schema.names, "lang_pred", "score", "rejected"])

    schema = rows.drop(*dropped).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema
    made = rows.mapInArrow(predicted, schema)
    names = {key: "id", text: "text", **{c: f"kept_{i}" for i, c in enumerate(others)}}
    return made.select(F.col("id").alias(key), "lang_pred", "score", "rejected", *[F.col(names[c]).alias(c) for c in keep if c != key])
