"""The lookups as table functions in SQL, for use alone or in LATERAL joins over a table of arguments.

The lookups are SQL functions that the planner inlines, so a lateral call becomes one distributed join, not a job for
each row. What does not depend on a request, like texts in lower case, is made below that join, once for each document.
Chunking and tokens, which need Python, are Python table functions; ``chunks`` tells its columns by ``analyze``.
Arguments that are null count as absent. Ties go to the smaller document id, as everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from kelpline.functions import text as tx
from kelpline.operators.chunking import split_recursively
from kelpline.operators.inverted import index_tokens
from kelpline.operators.lookup import ALIASES
from kelpline.session import ship

FORMS = """CREATE OR REPLACE TEMPORARY FUNCTION {p}find_forms(keyword STRING DEFAULT '')
RETURNS TABLE (doc_id BIGINT, title STRING, url STRING, score INT)
RETURN SELECT doc_id, title, url, score FROM (
    SELECT doc_id, title, url, score, row_number() OVER (PARTITION BY title, url ORDER BY doc_id) AS place FROM (
        SELECT doc_id, title, url, IF(word = '', 0, 3 * INT(contains(low_title, word)) + INT(contains(low_text, word))) AS score, word, nth
        FROM (SELECT doc_id, title, url, low_title, low_text, nth_form AS nth, lower(trim(coalesce(find_forms.keyword, ''))) AS word FROM {p}docs WHERE category = '表單'))
    WHERE score > 0 OR (word = '' AND nth <= 20))
WHERE place = 1 ORDER BY score DESC, doc_id LIMIT 20"""

NEWS = """CREATE OR REPLACE TEMPORARY FUNCTION {p}get_latest_news(keyword STRING DEFAULT '', of_dept STRING DEFAULT NULL)
RETURNS TABLE (doc_id BIGINT, title STRING, date STRING, score BIGINT)
RETURN SELECT doc_id, title, date, score FROM (
    SELECT doc_id, title, date, score, row_number() OVER (PARTITION BY title ORDER BY score DESC, date DESC, doc_id) AS place FROM (
        SELECT doc_id, title, date, aggregate(tokens, 0L, (s, t) -> s + (length(scored) - length(replace(scored, t, ''))) div length(t)) AS score FROM (
            SELECT doc_id, title, date, dept, scored, gated, coalesce(get_latest_news.keyword, '') AS word, regexp_extract_all(lower(coalesce(get_latest_news.keyword, '')), '{runs}', 1) AS tokens
            FROM {p}docs WHERE type = 'news')
        WHERE (get_latest_news.of_dept IS NULL OR dept = get_latest_news.of_dept) AND (word = '' OR exists(tokens, t -> contains(gated, t)))))
WHERE place = 1 ORDER BY score DESC, date DESC, doc_id LIMIT 6"""

SCHEDULE = """CREATE OR REPLACE TEMPORARY FUNCTION {p}get_schedule(year INT DEFAULT NULL)
RETURNS TABLE (doc_id BIGINT, title STRING, date STRING, exact BOOLEAN)
RETURN SELECT doc_id, title, date, exact FROM (
    SELECT doc_id, title, date, get_schedule.year IS NULL OR contains(both, string(get_schedule.year)) OR contains(both, string(get_schedule.year - 1911))
        OR coalesce(startswith(date, string(get_schedule.year)), false) AS exact FROM {p}docs WHERE schedule)
ORDER BY exact DESC, date DESC, doc_id LIMIT 1"""

RECORDS = """CREATE OR REPLACE TEMPORARY FUNCTION {p}get_competition_records(keyword STRING DEFAULT '', year STRING DEFAULT '', name STRING DEFAULT '')
RETURNS TABLE (doc_id BIGINT, text STRING, mode STRING, total BIGINT)
RETURN SELECT doc_id, text, IF(strict_total > 0, 'strict', 'relaxed'), IF(strict_total > 0, strict_total, least(loose_total, 15L)) FROM (
    SELECT doc_id, text, strict_total, loose_total, row_number() OVER (ORDER BY doc_id) AS place FROM (
        SELECT doc_id, text, has, count_if(has) OVER () AS strict_total, count(1) OVER () AS loose_total FROM (
            SELECT doc_id, text, word = '' OR exists(array_append(filter(split(word, '[/、\\\\s／]+'), p -> length(p) >= 2), word), p -> contains(body, p)) OR coalesce(contains(body, map({aliases})[word]), false) AS has,
                word <> '' AND (y <> '' OR n <> '') AS drops, (n = '' OR contains(body, n)) AS named,
                y = '' OR coalesce(contains(body, y) OR contains(body, string(IF(try_cast(y AS INT) > 1911, try_cast(y AS INT) - 1911, try_cast(y AS INT) + 1911))) AND try_cast(y AS INT) IS NOT NULL, false) AND y RLIKE '^[0-9]+$' AS dated
            FROM (SELECT doc_id, text, coalesce(text, '') AS body, coalesce(get_competition_records.keyword, '') AS word, trim(coalesce(get_competition_records.year, '')) AS y, coalesce(get_competition_records.name, '') AS n
                FROM {p}docs WHERE type = 'grade'))
        WHERE named AND dated AND (has OR drops))
    WHERE has OR strict_total = 0)
WHERE place <= IF(strict_total > 0, 25, 15)"""


class Chunks:
    """(chunk_id, chunk) of a text, or (chunk_id, chunk, chars) if a third argument, a constant, asks for lengths."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, lengths: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.isTable or text.dataType != StringType():
            raise ValueError("chunks takes a text")
        schema = StructType().add("chunk_id", IntegerType()).add("chunk", StringType())
        return AnalyzeResult(schema.add("chars", IntegerType()) if lengths is not None and lengths.value else schema)

    def eval(self, text: str | None, size: int = 800, lengths: bool = False) -> Iterator[tuple]:
        for i, chunk in enumerate(split_recursively(text, size, overlap=min(150, size // 4)) if text else ()):
            yield (i, chunk, len(chunk)) if lengths else (i, chunk)


class Tokens:
    """(position, token) of a text, as the index has them."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from enumerate(index_tokens(text or ""))


def register(spark: SparkSession, docs, prefix: str = "kb_") -> list[str]:
    """Registers the functions over *docs* (doc_id, dept, type, category, title, url, date, text) and gives their names."""
    ship(spark)
    title, body = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    first = docs.where(F.col("category") == "表單").orderBy("doc_id").limit(20).select("doc_id", F.lit(1).alias("nth_form"))  # 20 rows
    view = docs.join(F.broadcast(first), "doc_id", "left").withColumns({
        "low_title": F.lower(title), "low_text": F.lower(body), "scored": F.lower(F.concat(title, F.lit(" "), body)), "gated": F.lower(F.concat(body, title)), "both": F.concat_ws(" ", title, body), "schedule": tx.is_schedule(F.col("title"), F.col("text")),
    })
    view.createOrReplaceTempView(f"{prefix}docs")
    aliases = ", ".join(f"'{a}', '{b}'" for a, b in ALIASES.items())
    names = ["find_forms", "get_latest_news", "get_schedule", "get_competition_records"]
    for name, sql in zip(names, (FORMS, NEWS, SCHEDULE, RECORDS)):
        spark.sql(sql.replace(f"{name}.", f"{prefix}{name}.").format(p=prefix, runs=tx.KEYWORD_RUNS, aliases=aliases))
    spark.udtf.register(f"{prefix}chunks", udtf(Chunks))
    spark.udtf.register(f"{prefix}tokens", udtf(Tokens, returnType="position int, token string"))
    return [f"{prefix}{name}" for name in (*names, "chunks", "tokens")]
