"""Structured lookups: filters, weighted scores, dedupe, limits and relaxed fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions import text as tx


def first_per(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first row of each key in *order*, then the first *n* of those in the same order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") == 1).drop("_place").orderBy(*order).limit(n)


def latest_news(docs: DataFrame, n: int = 6, dept: str | None = None) -> DataFrame:
    """The newest row of each title; dates are text and compare as text, ties by id."""
    rows = docs if dept is None else docs.where(F.col("dept") == dept)
    return first_per(rows, ["title"], [F.desc("date"), F.asc("doc_id")], n)


def keyword_news(docs: DataFrame, query: str, n: int = 6, dept: str | None = None) -> DataFrame:
    """Rows by occurrences of the query's tokens, then date. A second count, over body and title joined without a
    space, decides which rows count at all. A query without tokens finds nothing."""
    tokens = tx.keyword_tokens(query)
    rows = docs if dept is None else docs.where(F.col("dept") == dept)
    title, body = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    low = rows.withColumns({"_scored": F.lower(F.concat(title, F.lit(" "), body)), "_gated": F.lower(F.concat(body, title))})
    scored = low.withColumn("score", tx.total_occurrences(F.col("_scored"), tokens))
    found = scored.where(F.greatest(*[F.contains("_gated", F.lit(t)) for t in tokens]) if len(tokens) > 1 else F.contains("_gated", F.lit(tokens[0])) if tokens else F.lit(False))
    return first_per(found.drop("_scored", "_gated"), ["title"], [F.desc("score"), F.desc("date"), F.asc("doc_id")], n)


def find_forms(forms: DataFrame, keyword: str, n: int = 20) -> DataFrame:
    """Forms by 3 for the title and 1 for the body, first of each (title, url). Without a keyword the first *n*
    rows are taken before they are deduplicated, so there may be fewer."""
    word = keyword.strip().lower()
    if not keyword:
        first = forms.orderBy("doc_id").limit(n).withColumn("score", F.lit(0))
        return first_per(first, ["title", "url"], [F.asc("doc_id")], n)
    hit = lambda c: F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(word)), 1).otherwise(0)
    scored = forms.withColumn("score", 3 * hit("title") + hit("text")).where(F.col("score") > 0)
    place = F.row_number().over(Window.partitionBy("title", "url").orderBy("doc_id"))
    firsts = scored.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")
    return firsts.orderBy(F.desc("score"), "doc_id").limit(n)


#: Short names of events and what records call them.
ALIASES = {"全大運": "全國大專校院運動會", "大專運動會": "全國大專校院運動會"}


def keyword_forms(keyword: str) -> list[str]:
    """The keyword, its alias and its parts of two characters and more."""
    import re

    parts = [p for p in re.split(r"[/、\s／]+", keyword) if len(p) >= 2]
    return [keyword, *([ALIASES[keyword]] if keyword in ALIASES else []), *parts] if keyword else []


def find_records(records: DataFrame, keyword: str = "", year: str = "", name: str = "", most: int = 25, relaxed_most: int = 15) -> DataFrame:
    """(doc_id, text, mode, total): records with any form of the keyword, the name and the year in either calendar.

    ``total`` counts all matches, of which ``most`` are listed. If a keyword finds nothing though a year or a name is
    given too, it is dropped and ``relaxed_most`` rows are listed. A year that is not a number matches nothing.
    """
    body = F.coalesce("text", F.lit(""))
    year = year.strip()
    has = lambda part: F.contains(body, F.lit(part))
    both = [year, str(int(year) - 1911 if int(year) > 1911 else int(year) + 1911)] if year.isdecimal() else []
    loose = F.lit(True)
    if name:
        loose &= has(name)
    if year:
        loose &= (has(both[0]) | has(both[1])) if both else F.lit(False)
    forms = keyword_forms(keyword)
    strict = loose
    if forms:
        strict = loose & F.array_contains(F.array(*[has(f) for f in forms]), True)
    marked = records.where(loose).withColumn("strict", strict)
    if not (keyword and (year or name)):
        marked = marked.where("strict")
    counted = marked.agg(F.count_if("strict").alias("strict_total"), F.count(F.lit(1)).alias("loose_total"))
    strict_total = F.col("strict_total")
    kept = marked.join(F.broadcast(counted)).where(F.col("strict") | (strict_total == 0))
    mode = F.when(strict_total > 0, F.lit("strict")).otherwise(F.lit("relaxed"))
    limits = F.when(strict_total > 0, most).otherwise(relaxed_most)
    total = F.when(strict_total > 0, strict_total).otherwise(F.least("loose_total", F.lit(relaxed_most).cast("long")))
    listed = kept.orderBy("doc_id").limit(max(most, relaxed_most)).withColumn("_place", F.row_number().over(Window.orderBy("doc_id")))  # that many rows
    return listed.where(F.col("_place") <= limits).select("doc_id", "text", mode.alias("mode"), total.alias("total"))


def schedule(docs: DataFrame, year: int | None = None) -> DataFrame:
    """The newest schedule, of a year if one names it; ``exact`` tells whether one did."""
    found = docs.where(tx.is_schedule(F.col("title"), F.col("text")))
    exact = F.lit(True) if year is None else tx.names_year(F.col("title"), F.col("text"), F.col("date"), year)
    return found.withColumn("exact", exact).orderBy(F.desc("exact"), F.desc("date"), "doc_id").limit(1)


def find_professors(docs: DataFrame, expertise: str, page: str = "師資介紹") -> DataFrame:
    """Staff pages that hold the expertise; an empty one finds nothing."""
    return docs.where((F.col("page") == page) & F.contains(F.col("text"), F.lit(expertise)) & F.lit(bool(expertise)))


def list_sources(hits: DataFrame) -> DataFrame:
    """(query_id, candidates): title (or page), url and type of the hits but corrections, each once, in rank order."""
    named = hits.where(F.coalesce(F.col("type"), F.lit("")) != "correction").select(
        "query_id", "rank", F.struct(F.coalesce(tx.blank_to_null(F.col("title")), F.col("page"), F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("type", F.lit("")).alias("type")).alias("source")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda s: s["source"])  # a few hits per query
    return named.groupBy("query_id").agg(F.array_distinct(ordered).alias("candidates"))


#: Words of answers that found nothing.
NO_ANSWER = ("查無", "沒有查到明確答案", "暫時沒有整理出", "暫時無法整理出")


def attribute_sources(answers: DataFrame, fallback: int = 2) -> DataFrame:
    """*answers* (answer, candidates) with ``sources``: candidates that the answer names without linking them.

    Where it names and links none and does not say that it found nothing, the first *fallback* candidates stand in.
    Candidates lie in their answer's row, so the comparison needs no join.
    """
    answer = F.coalesce("answer", F.lit(""))
    linked = lambda c: (c["url"] != "") & F.contains(answer, c["url"])
    key = lambda c: tx.citation_key(c["title"])
    named = lambda c: (F.length(key(c)) >= 4) & F.contains(answer, key(c))
    slim = lambda cs: F.array_distinct(F.transform(cs, lambda c: F.struct(c["title"].alias("title"), c["url"].alias("url"))))
    extra = slim(F.filter("candidates", lambda c: ~linked(c) & named(c)))
    silent = F.lit(False)
    for words in NO_ANSWER:
        silent |= F.contains(answer, F.lit(words))
    stand_in = (F.size(extra) == 0) & ~F.exists("candidates", linked) & ~silent
    return answers.withColumn("sources", F.when(stand_in, slim(F.slice("candidates", 1, fallback))).otherwise(extra))
