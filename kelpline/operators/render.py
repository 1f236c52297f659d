"""Rendering of found rows, and titles read back from rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions import text as tx

#: Words and patterns of rendered results.
LINK = r"\[[^\]]+?\]\(https?://[^\s)]+\)"
REGULATION_MARK = " [法規文件]"
TITLE_PATTERNS = (r"Title:\s*(.*?)(?=\n)", r"【標題】：\s*(.*?)(?=\n)", r"-\s*\*\*(.*?)\*\*", r"賽事名稱：(.*?)(?=，)")
NO_TOOL = "無呼叫檢索工具"
NEWS_DATE, NEWS_UNDATED, NEWS_TITLE, NEWS_BODY = "【日期】：", "未註明日期", "\n【標題】：", "\n【公告內容摘要】：\n"
LISTED, LISTED_KIND, LISTED_END, LISTED_URL, LISTED_BODY = "- **", "**（", "）", "\n  - 連結：", "\n  - 摘要："


def _joined(rows: DataFrame, by: str, line: Column, between: str) -> DataFrame:
    """(by, text): the lines of each key in order of ``rank``; each key has the few rows of one answer."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(ordered, lambda r: r["line"]), between).alias("text"))


def bullet_list(rows: DataFrame, by: str = "query_id") -> DataFrame:
    """Title, date and the first link of the text, regulations marked."""
    mark = F.when(F.col("source") == "regulations", F.lit(REGULATION_MARK)).otherwise(F.lit(""))
    line = F.concat(F.lit("- **"), F.coalesce("title", F.lit("")), F.lit("** — "), F.coalesce("date", F.lit("")), F.lit("  "), F.regexp_extract(F.coalesce("text", F.lit("")), LINK, 0), mark)
    return _joined(rows, by, line, "\n")


def news_list(rows: DataFrame, by: str = "query_id", most: int = 800) -> DataFrame:
    """Date, title and the beginning of the text; only a missing date, not an empty one, is named so."""
    preview = tx.decode_url(F.substring(F.coalesce("text", F.lit("")), 1, most))
    line = F.concat(F.lit(NEWS_DATE), F.coalesce("date", F.lit(NEWS_UNDATED)), F.lit(NEWS_TITLE), F.coalesce("title", F.lit("")), F.lit(NEWS_BODY), preview, F.lit("\n"))
    return _joined(rows, by, line, "\n---\n")


def fallback_list(rows: DataFrame, by: str = "query_id", most: int = 120) -> DataFrame:
    """Title, category and a short preview of each (title, url), the first of each."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(by, "title", "url").orderBy("rank"))
    firsts = rows.withColumn("_place", place).where(F.col("_place") == 1)
    flat = F.replace(tx.strip(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" "))
    preview = F.concat(F.substring(flat, 1, most), F.when(F.length(flat) > most, F.lit("...")).otherwise(F.lit("")))
    link = F.when(F.col("url") != "", F.concat(F.lit(LISTED_URL), F.col("url"))).otherwise(F.lit(""))
    line = F.concat(F.lit(LISTED), F.col("title"), F.lit(LISTED_KIND), F.coalesce("category", F.col("type"), F.lit("")), F.lit(LISTED_END), link, F.lit(LISTED_BODY), preview)
    return _joined(firsts, by, line, "\n")


def harvested_titles(context: Column, tools: Column) -> Column:
    """Titles found in tool results, pattern after pattern, each once; else the tools called; else that none was."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit(p), F.lit(1)) for p in TITLE_PATTERNS]))
    called = F.concat(F.lit("使用工具: "), F.array_join(tools, ", "))
    return F.when(F.size(found) > 0, F.array_join(found, " | ")).when(F.size(tools) > 0, called).otherwise(F.lit(NO_TOOL))


def stage_seconds(stages: Column, most: int = 50) -> Column:
    """Sum of the first *most* recorded stage times; nested stages count again."""
    return F.aggregate(F.slice(stages, 1, most), F.lit(0.0), lambda acc, s: acc + s["seconds"])
