"""Lookups for a whole table of requests in one pass over the documents.

The words of all requests make one Aho-Corasick automaton, which each task runs over its texts; the hits of a
document are added up for every request at once, and each task hands on only what can still be among the first rows
of a request, or may hide a copy that could, and holds HELD rows and as many new ones at most beside those of its requests. Results equal those of the single lookups in ``lookup``, request by request. Requests go in blocks of
REQUESTS, each a pass of its own whose rows are stored, so neither the driver nor a task holds more than a block.

Null requests count as empty ones; requests without an id and documents without an id take no part; repeated ids of
requests are one request, of the least values; rows of a repeated document id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions import text as tx
from kelpline.operators.lookup import keyword_forms
from kelpline.session import Scratch, prepare

REQUESTS = 20_000
HELD = 100_000  # rows that a task holds before it drops those that cannot come first


class Words:
    """An automaton over the words of requests; for each word who asks for it, and how (*role*) or how often (*times*)."""

    def __init__(self, asked: list[tuple[str, int, int]]):
        import ahocorasick

        number: dict[str, int] = {}
        for word, *_ in asked:
            number.setdefault(word, len(number))
        order = sorted(range(len(asked)), key=lambda i: number[asked[i][0]])
        self.who = np.array([asked[i][1] for i in order], np.int64)
        self.times = np.array([asked[i][2] for i in order], np.int64)
        self.begins = np.searchsorted([number[asked[i][0]] for i in order], np.arange(len(number) + 1))
        self.lengths = [len(w) for w in number]
        self.automaton = ahocorasick.Automaton()
        for word, i in number.items():
            self.automaton.add_word(word, i)
        if number:
            self.automaton.make_automaton()

    def found(self, text: str) -> set[int]:
        return {i for _, i in self.automaton.iter(text)} if self.lengths else set()

    def counted(self, text: str) -> dict[int, int]:
        """Occurrences of each word that do not overlap, from left to right."""
        counts: dict[int, int] = {}
        upto: dict[int, int] = {}
        for end, i in self.automaton.iter(text) if self.lengths else ():
            if end - self.lengths[i] >= upto.get(i, -1):
                counts[i], upto[i] = counts.get(i, 0) + 1, end
        return counts

    def entries(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(entry, word's place in *words*) of all that ask for one of *words*."""
        words = np.fromiter(words, np.int64)
        counts = self.begins[words + 1] - self.begins[words] if len(words) else words
        at = np.repeat(np.arange(len(words)), counts)
        return np.arange(int(counts.sum())) + np.repeat(self.begins[words] - (np.cumsum(counts) - counts), counts) if len(words) else words, at


class _Held:
    """Rows that a task keeps; *best* drops those that cannot come first, and is called when many have come."""

    def __init__(self, names: list[str], best: Callable[[pd.DataFrame], pd.DataFrame]):
        self.names, self.best = names, best
        self.clear()

    def clear(self) -> None:
        self.rows, self.parts, self.size = pd.DataFrame({n: [] for n in self.names}), [], 0

    def add(self, **columns) -> bool:
        """Whether rows were dropped just now. A column is an array, or one value for all rows of the array of requests."""
        self.parts.append(columns)
        self.size += len(columns["request"])
        return self.size > HELD and self.drop() is not None

    def drop(self) -> pd.DataFrame:
        if self.parts:
            counts = [len(p["request"]) for p in self.parts]

            def whole(values: list) -> np.ndarray:
                if isinstance(values[0], np.ndarray):
                    return np.concatenate(values)
                return np.repeat(np.array(values, np.int64 if isinstance(values[0], int) else object), counts)

            new = pd.DataFrame({n: whole([p[n] for p in self.parts]) for n in self.names})
            self.rows = self.best(pd.concat([self.rows, new], ignore_index=True) if len(self.rows) else new)
        self.parts, self.size = [], 0 if len(self.rows) > HELD // 2 else len(self.rows)
        return self.rows


def _in_blocks(requests: DataFrame, columns: list[str], one_pass: Callable[[list], DataFrame], schema: str) -> tuple[DataFrame, Scratch]:
    """What *one_pass* makes of each block of the requests' rows, stored."""
    spark = requests.sparkSession
    scratch = Scratch(spark)
    scratch.drop_at_exit()
    place = f"{scratch.folder}/passes"
    named = requests.where(F.col("request_id").isNotNull()).select(F.col("request_id").cast("long").alias("request_id"), *columns)
    asked = scratch.cut(named.groupBy("request_id").agg(F.min(F.struct(*columns)).alias("r")).select("request_id", "r.*"))
    blocks = max(1, -(-asked.count() // REQUESTS))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("request_id"), F.lit(blocks)) == block).orderBy("request_id").collect()  # about REQUESTS
        one_pass(rows).write.mode("append").parquet(place)
    return spark.read.schema(schema).parquet(place), scratch


def keyword_news(docs: DataFrame, requests: DataFrame, n: int = 6) -> DataFrame:
    """(request_id, position, doc_id, score, date) for *requests* (request_id, query, dept or null for all); *docs* have doc_id,
    title, text, date and dept. Runs at once."""
    prepare(docs.sparkSession)
    title, body = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "title", "date", "dept", F.lower(F.concat(title, F.lit(" "), body)).alias("scored"), F.lower(F.concat(body, title)).alias("gated"))
    schema = "request_id long, doc_id long, title string, date string, score long"
    names = [c.split()[0] for c in schema.split(", ")]

    def one_pass(asked: list) -> DataFrame:
        ids = np.array([r.request_id for r in asked], np.int64)
        words = [(t, i, 1) for i, r in enumerate(asked) for t in tx.keyword_tokens(r.query or "")]
        depts: dict[str, int] = {}
        own = np.array([-1 if r.dept is None else depts.setdefault(r.dept, len(depts)) for r in asked], np.int64)

        def first(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["request", "score", "date", "doc_id"], ascending=[True, False, False, True], kind="stable")
            return rows.drop_duplicates(["request", "title"]).groupby("request", sort=False).head(n)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, held = Words(words), _Held(["request", "doc_id", "title", "date", "score"], first)
            floors = np.zeros(len(ids), np.int64)
            for batch in batches:
                for doc_id, title, date, dept, scored, gated in zip(*(c.to_pylist() for c in batch.columns)):
                    entry, _ = known.entries(known.found(gated))
                    if not len(entry):
                        continue
                    told = np.unique(known.who[entry])
                    told = told[(own[told] < 0) | (own[told] == depts.get(dept, -2))]
                    counts = known.counted(scored)
                    entry, at = known.entries(counts)
                    much = np.fromiter(counts.values(), np.int64)[at] if len(entry) else np.zeros(0, np.int64)
                    score = np.bincount(known.who[entry], much, len(ids)).astype(np.int64)[told]
                    keep = score >= floors[told]
                    if keep.any() and held.add(request=told[keep], doc_id=doc_id, title=title, date=date, score=score[keep]):
                        last = held.rows.groupby("request")["score"].agg(["size", "min"])
                        full = last[last["size"] == n]
                        floors[full.index.to_numpy(np.int64)] = full["min"].to_numpy()
            rows = held.drop()
            arrays = [pa.array(ids[rows["request"].to_numpy(np.int64)]), pa.array(rows["doc_id"].to_numpy(np.int64)), pa.array(list(rows["title"]), pa.string()), pa.array(list(rows["date"]), pa.string()), pa.array(rows["score"].to_numpy(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names)

        return rows.mapInArrow(scan, schema)

    found, _ = _in_blocks(requests, ["query", "dept"], one_pass, schema)
    order = [F.desc("score"), F.desc("date"), F.asc("doc_id")]
    one_each = found.withColumn("_place", F.row_number().over(Window.partitionBy("request_id", "title").orderBy(*order))).where(F.col("_place") == 1)
    placed = one_each.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)))
    return placed.where(F.col("position") <= n).select("request_id", "position", "doc_id", "score", "date")


def find_forms(forms: DataFrame, requests: DataFrame, n: int = 20) -> DataFrame:
    """(request_id, position, doc_id, score) for *requests* (request_id, keyword); *forms* have doc_id, title, url and text. Runs at once."""
    prepare(forms.sparkSession)
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = forms.where(F.col("doc_id").isNotNull()).select("doc_id", "title", "url", low("title").alias("low_title"), low("text").alias("low_text"))
    schema = "request_id long, doc_id long, title string, url string, score int"
    names = [c.split()[0] for c in schema.split(", ")]

    def one_pass(asked: list) -> DataFrame:
        asked = [r for r in asked if r.keyword]
        ids = np.array([r.request_id for r in asked], np.int64)
        said = [r.keyword.strip().lower() for r in asked]
        words = [(w, i, 1) for i, w in enumerate(said) if w]
        always = np.array([not w for w in said], bool)  # white space is in every text

        # Forms of one title and url are all found by it or none is. If none is, or white space is asked for, they score the same, so
        # where n others come before the first of them in this task, n others do in all. If all are, texts decide between 3 and 4.
        def first(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["request", "doc_id"], kind="stable").drop_duplicates(["request", "title", "url"])
            rows = rows.assign(late=rows["score"] < 3).sort_values(["request", "late", "doc_id"], kind="stable")
            same = rows["late"].to_numpy(bool) | always[rows["request"].to_numpy(np.int64)]
            return rows[~same | (rows.groupby("request").cumcount().to_numpy() < n)].drop(columns="late")

        def told(rows: pd.DataFrame) -> pa.RecordBatch:
            arrays = [pa.array(ids[rows["request"].to_numpy(np.int64)]), pa.array(rows["doc_id"].to_numpy(np.int64)), pa.array(list(rows["title"]), pa.string()), pa.array(list(rows["url"]), pa.string()), pa.array(rows["score"].to_numpy(np.int32))]
            return pa.RecordBatch.from_arrays(arrays, names)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, held = Words(words), _Held(["request", "doc_id", "title", "url", "score"], first)
            least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            floors = np.full(len(ids), most)  # the last id with which a form that scores like all of its title and url can come first
            for batch in batches:
                for doc_id, title, url, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                    score = np.where(always, 4, 0)
                    for weight, text in zip((3, 1), texts):
                        entry, _ = known.entries(known.found(text))
                        score[known.who[entry]] += weight
                    hit = np.flatnonzero((score > 0) & ((doc_id <= floors) | (score >= 3) & ~always))
                    if len(hit) and held.add(request=hit, doc_id=doc_id, title=title, url=url, score=score[hit]):
                        nth = held.rows.groupby("request").nth(n - 1)
                        at = nth["request"].to_numpy(np.int64)
                        floors[at] = np.minimum(floors[at], np.where((nth["score"].to_numpy() < 3) | always[at], nth["doc_id"].to_numpy(np.int64), least))
                        if len(held.rows) > HELD // 2:  # titles that are found: handed on, so that a task holds no more of them
                            yield told(held.rows)
                            held.clear()
            yield told(held.drop())

        return rows.mapInArrow(scan, schema)

    found, scratch = _in_blocks(requests, ["keyword"], one_pass, schema)
    blank = requests.where(F.col("request_id").isNotNull()).groupBy(F.col("request_id").cast("long").alias("request_id")).agg(F.min("keyword").alias("keyword")).where(F.coalesce("keyword", F.lit("")) == "")
    few = scratch.cut(rows.orderBy("doc_id").limit(n).select("doc_id", "title", "url"))  # n rows
    listed = F.array_agg(F.struct("doc_id", "title", "url"))
    every = blank.crossJoin(F.broadcast(few.agg(listed.alias("few")))).select("request_id", F.inline("few")).select("request_id", "doc_id", "title", "url", F.lit(0).alias("score"))  # one row of n
    one_each = found.unionByName(every).withColumn("_place", F.row_number().over(Window.partitionBy("request_id", "title", "url").orderBy("doc_id"))).where(F.col("_place") == 1)
    placed = one_each.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "doc_id")))
    return placed.where(F.col("position") <= n).select("request_id", "position", "doc_id", "score")


def find_records(records: DataFrame, requests: DataFrame, most: int = 25, relaxed_most: int = 15) -> DataFrame:
    """(request_id, position, doc_id, mode, total) for *requests* (request_id, keyword, year, name); *records* have doc_id and text. Runs at once."""
    prepare(records.sparkSession)
    rows = records.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "request_id long, strict boolean, doc_id long, total long"
    names = [c.split()[0] for c in schema.split(", ")]

    def one_pass(asked: list) -> DataFrame:
        ids = np.array([r.request_id for r in asked], np.int64)
        words, needs, never, drops = [], np.zeros((len(asked), 3), bool), np.zeros(len(asked), bool), np.zeros(len(asked), bool)
        for i, r in enumerate(asked):
            keyword, year, name = r.keyword or "", (r.year or "").strip(), r.name or ""
            years = [year, str(int(year) - 1911 if int(year) > 1911 else int(year) + 1911)] if year.isdecimal() else []
            never[i], needs[i] = bool(year) and not years, (bool(keyword), bool(name), bool(years))
            drops[i] = bool(keyword and (year or name))
            words += [(w, i, role) for role, own in enumerate((keyword_forms(keyword), [name] if name else [], years)) for w in own]

        def first(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["request", "strict", "doc_id"], kind="stable")
            return rows.groupby(["request", "strict"], sort=False).head(max(most, relaxed_most))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, held = Words(words), _Held(["request", "strict", "doc_id"], first)
            totals = np.zeros((2, len(ids)), np.int64)
            for batch in batches:
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                    has = ~needs
                    entry, _ = known.entries(known.found(text))
                    has[known.who[entry], known.times[entry]] = True
                    loose = has[:, 1] & has[:, 2] & ~never
                    strict = loose & has[:, 0]
                    for kind, hit in enumerate((loose & drops, strict)):
                        totals[kind] += hit
                        if hit.any():
                            held.add(request=np.flatnonzero(hit), strict=bool(kind), doc_id=doc_id)
            rows = held.drop()
            kind, who = np.nonzero(totals)
            arrays = [
                pa.array(np.concatenate([ids[rows["request"].to_numpy(np.int64)], ids[who]])), pa.array([*rows["strict"].astype(bool), *(kind == 1)], pa.bool_()),
                pa.array([*rows["doc_id"].astype("int64"), *[None] * len(who)], pa.int64()), pa.array([*[None] * len(rows), *totals[kind, who].tolist()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

        return rows.mapInArrow(scan, schema)

    found, _ = _in_blocks(requests, ["keyword", "year", "name"], one_pass, schema)
    counted = found.where(F.col("doc_id").isNull()).groupBy("request_id").agg(F.coalesce(F.sum(F.when(F.col("strict"), F.col("total"))), F.lit(0)).alias("strict_total"), F.coalesce(F.sum(F.when(~F.col("strict"), F.col("total"))), F.lit(0)).alias("loose_total"))
    exact = F.col("strict_total") > 0
    listed = found.where(F.col("doc_id").isNotNull()).drop("total").join(counted, "request_id").where(F.col("strict") == exact)
    placed = listed.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy("doc_id"))).where(F.col("position") <= F.when(exact, most).otherwise(relaxed_most))
    mode, total = F.when(exact, F.lit("strict")).otherwise(F.lit("relaxed")), F.when(exact, F.col("strict_total")).otherwise(F.least("loose_total", F.lit(relaxed_most).cast("long")))
    return placed.select("request_id", "position", "doc_id", mode.alias("mode"), total.alias("total"))
