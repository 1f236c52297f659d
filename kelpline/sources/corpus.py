"""One typed corpus from all sources: the documents that retrieval and lookups work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import metadata
from kelpline.sources import markdown as md

#: Pages and titles that documents of a kind carry.
NEWS_PAGE, FAQ_PAGE, RESULTS_PAGE = "最新消息", "常見問題", "競賽成績"
CORRECTION_PAGE, CORRECTION_TITLE = "系統修正紀錄", "使用者糾正資訊"
PAGED = "### Page"
FIRST_DEPT = "ope"

SCHEMA = "dept string, type string, page string, title string, date string, url string, category string, ext string, source string, chunk_id int, text string"
_FIELDS = [part.split(" ")[0] for part in SCHEMA.split(", ")]


def _typed(rows: DataFrame, part: int, order: list[str], **fields) -> DataFrame:
    """*rows* in the corpus's columns, with their place: the part, then up to five numbers or texts of *order*."""
    has = set(rows.columns)
    kinds = dict(p.split(" ") for p in SCHEMA.split(", "))
    value = lambda c: fields[c] if c in fields else F.col(c) if c in has else F.lit(None)
    place = [F.format_string("%012d", F.col(c)) if dict(rows.dtypes)[c] in ("int", "bigint") else F.col(c) for c in order]
    return rows.select(F.lit(part).alias("_part"), F.concat_ws("/", *place).alias("_place"), *[value(c).cast(kinds[c]).alias(c) for c in _FIELDS])


def news_documents(pages: DataFrame, part: int, dept: str, banners: bool) -> DataFrame:
    """News of the news page, chunked; *banners*: whether items that only say their text could not be fetched stay."""
    items = md.news(pages.where(F.col("page_key") == NEWS_PAGE).select("path", "page_seq", "body"))
    chunks = md.news_chunks(items if banners else md.without_banners(items))
    return _typed(chunks, part, ["path", "page_seq", "seq", "chunk_id"], dept=F.lit(dept), type=F.lit("news"), page=F.lit(NEWS_PAGE), text=F.col("chunk"), chunk_id=F.lit(None))


def faq_documents(pages: DataFrame, part: int, dept: str, url: str = "") -> DataFrame:
    rows = md.faqs(pages.where(F.col("page_key") == FAQ_PAGE).select("path", "page_seq", "body"))
    text = F.concat(F.lit("Q: "), "title", F.lit("\n\nA:\n"), "body")
    return _typed(rows, part, ["path", "page_seq", "seq"], dept=F.lit(dept), type=F.lit("faq"), page=F.lit(FAQ_PAGE), url=F.lit(url), text=text)


def page_documents(pages: DataFrame, part: int, dept: str, compat: bool = False) -> DataFrame:
    """The other pages: one document each, but a page of results is one for each of its rows. ``compat`` puts every page
    in twice, results as a whole page first, as the reference data does."""
    rest = pages.where(~F.col("page_key").isin(NEWS_PAGE, FAQ_PAGE))
    results = F.contains("page_key", F.lit(RESULTS_PAGE))
    whole = lambda rows, n: _typed(rows, n, ["path", "page_seq"], dept=F.lit(dept), type=F.lit("page"), page=F.col("page_key"), title=F.col("page_key"), text=F.col("body"))
    rows = _typed(md.grades(rest.where(results).select("path", "page_seq", "body")), part + 1, ["path", "page_seq", "seq"], dept=F.lit(dept))
    out = whole(rest.where(~results), part + 1).unionByName(rows)
    return whole(rest, part).unionByName(out) if compat else out


def regulation_documents(pages: DataFrame, meta: DataFrame | None, part: int, dept: str) -> DataFrame:
    """Chunks of regulation pages with the metadata of their normalised titles."""
    chunks = md.regulation_pages(pages.where(F.contains("body", F.lit(PAGED))).select("path", F.col("page_seq").alias("h1_seq"), "body"))
    meta = chunks.sparkSession.createDataFrame([], "title_norm string, url string, category string, type string, date string") if meta is None else meta
    joined = metadata.by_title(chunks, meta)
    return _typed(joined, part, ["path", "h1_seq", "section_no", "page_seq", "chunk_id"], dept=F.lit(dept), source=F.lit("regulations"), text=F.col("chunk"))


def correction_documents(files: DataFrame, part: int) -> DataFrame:
    rows = md.corrections(files)
    return _typed(rows, part, ["path", "seq"], type=F.lit("correction"), page=F.lit(CORRECTION_PAGE), title=F.lit(CORRECTION_TITLE))


def build(
    spark: SparkSession,
    main: DataFrame | None = None,
    regulations: DataFrame | None = None,
    corrections: DataFrame | None = None,
    crawled: dict[str, DataFrame] | None = None,
    regulation_files: dict[str, DataFrame] | None = None,
    meta: dict[str, DataFrame] | None = None,
    faq_urls: dict[str, str] | None = None,
    compat: bool = False,
) -> DataFrame:
    """(doc_id, dept, type, page, title, date, url, category, ext, source, chunk_id, text): the union of all sources.

    Sources are files (path, md), by department where there are several. The main files and the regulations and
    forms belong to the first department; corrections carry their own. ``doc_id`` counts from 0 in the order of
    sources: main news, questions, pages, regulations and forms, corrections, then each department's news, questions and
    regulations. Missing sources are left out.
    """
    meta, urls, parts = meta or {}, faq_urls or {}, []
    if main is not None:
        pages = md.pages(main)
        parts += [news_documents(pages, 0, FIRST_DEPT, True), faq_documents(pages, 1, FIRST_DEPT, urls.get(FIRST_DEPT, "")), page_documents(pages, 2, FIRST_DEPT, compat)]
    if regulations is not None:
        rows = md.regulations_and_forms(regulations)
        parts.append(_typed(rows, 4, ["path", "section_no", "page_seq", "chunk_id"], dept=F.lit(FIRST_DEPT), text=F.col("chunk")))
    if corrections is not None:
        parts.append(correction_documents(corrections, 5))
    number = 6
    for dept, files in (crawled or {}).items():
        pages = md.pages(files)
        parts += [news_documents(pages, number, dept, False), faq_documents(pages, number + 1, dept, urls.get(dept, "")), regulation_documents(pages, meta.get(dept), number + 2, dept)]
        number += 3
    for dept, files in (regulation_files or {}).items():
        whole = files.select("path", F.lit(0).alias("page_seq"), F.col("md").alias("body"))
        parts.append(regulation_documents(whole, meta.get(dept), number, dept))
        number += 1
    if not parts:
        return spark.createDataFrame([], f"doc_id long, {SCHEMA}")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return metadata.dense_ids(rows, ["_part", "_place"]).select("doc_id", *_FIELDS)
