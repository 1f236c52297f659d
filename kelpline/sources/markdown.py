"""Markdown knowledge bases as typed rows. Files are read whole, one row each; parsing is column work on those rows.

Patterns and marks that parsed results depend on are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions import text as tx
from kelpline.operators import chunking
from kelpline.session import prepare

#: Names, marks, patterns and separators that results depend on.
DEPTS = ("ope", "ge", "lc", "oaa", "osa")
NEWS_TITLE = "最新消息"
BANNER = "（無法擷取內文）"
CORRECTION_MARK = "## 修正紀錄"
CORRECTION_DEPT = r"(?m)^-\s*\*\*所屬處室\*\*：\s*([A-Za-z]+)"
GRADE_HEADERS = ("學年度", "賽事名稱")
GRADE_FIELDS = ("學年度", "賽事名稱", "競賽項目", "名次", "參賽學生/隊伍")
GRADE_PAGE, GRADE_HEAD, GRADE_TITLE = "競賽成績", "【競賽成績紀錄】", "成績紀錄："
OVERVIEW = "總覽"
UNKNOWN = "未知"
REGULATION = "法規"
HEADER_FIELDS = {"title": r"(?m)^##\s+📄\s*(.+?)\s*$", "category": r"(?m)^文件類型：\s*(.+?)\s*$", "url": r"(?m)^來源網址：\s*(https?://\S+)\s*$", "ext": r"(?m)^原始格式：\s*(.+?)\s*$"}
REGULATIONS_HEADING = "# 相關法規"
BOLD_LINK = r"\*\*\s*\[([^\]]+?)\]\(([^)]+?)\)\s*\*\*"
NEWS_DATE = r"##\s*(\d{4}\s*/\s*\d{1,2}\s*/\s*\d{1,2})"
NEWS_SEPARATORS = ("\n#### ", "\n### ", "\n\n", "\n", " ")
FORM_SEPARATORS = ("\n### ", "\n\n", "\n", " ")
REGULATION_SEPARATORS = ("\n\n", "\n", " ")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, md) of the paths that exist, without a byte-order mark; missing ones are left out."""
    found = []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            found.append(path)
    if not found:
        return spark.createDataFrame([], "path string, md string")
    rows = spark.read.text(found, wholetext=True)
    return rows.select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("md"))


def _sections(md: Column, marks: str) -> Column:
    """[(seq, title, body)] of the headings of a level; text before the first heading is dropped."""
    parts = F.split(F.concat(F.lit("\n"), md), rf"\n{marks}[ \t]+(?=\S)", -1)
    parts = F.slice(parts, F.lit(2), F.size(parts))
    return F.transform(
        parts,
        lambda p, i: F.struct(
            i.alias("seq"),
            tx.strip(F.substring_index(p, "\n", 1)).alias("title"),
            tx.strip(F.when(F.contains(p, F.lit("\n")), F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).otherwise(F.lit(""))).alias("body"),
        ),
    )


def _free_names(titles) -> list[str]:
    taken: dict[str, None] = {}  # in order
    for title in titles:
        name, n = title, 2
        while name in taken:
            name, n = f"{title}_{n}", n + 1
        taken[name] = None
    return list(taken)


def pages(files: DataFrame) -> DataFrame:
    """(path, page_seq, page_key, body): H1 pages; repeated titles take the first free of _2, _3, ... in each row of *files*."""
    split = files.where(F.col("md").isNotNull()).select("path", _sections(F.col("md"), "#").alias("sections"))

    # Names already taken decide the next, so the titles of one file (not its texts) are folded in order.
    @F.pandas_udf("array<string>")
    def free(lists: pd.Series) -> pd.Series:
        return lists.map(_free_names)

    prepare(files.sparkSession)
    keyed = split.withColumn("keys", free(F.transform("sections", lambda s: s["title"])))
    rows = keyed.select("path", F.explode(F.arrays_zip("sections", "keys")).alias("p"))
    return rows.select("path", F.col("p.sections.seq").alias("page_seq"), F.col("p.keys").alias("page_key"), F.col("p.sections.body").alias("body"))


def news(page: DataFrame, body: str = "body") -> DataFrame:
    """The page's columns and (seq, date, title, url, raw) of each block between rules of three dashes and more."""
    blocks = F.filter(F.transform(F.split(F.col(body), r"\n-{3,}\n", -1), tx.strip), lambda b: b != "")
    rows = page.select(*[c for c in page.columns if c != body], F.posexplode(blocks).alias("seq", "raw"))
    link = lambda i: tx.strip(F.regexp_extract("raw", BOLD_LINK, i))
    linked = F.regexp_extract("raw", BOLD_LINK, 0) != ""
    return rows.withColumns({"date": F.regexp_extract("raw", NEWS_DATE, 1), "title": F.when(linked, link(1)).otherwise(F.lit(NEWS_TITLE)), "url": F.when(linked, link(2)).otherwise(F.lit(""))})


def without_banners(items: DataFrame) -> DataFrame:
    """News without the short items that only say their text could not be fetched."""
    return items.where(~(F.contains("raw", F.lit(BANNER)) & (F.length("raw") < 400)))


def news_chunks(items: DataFrame) -> DataFrame:
    """News rows, chunked when 800 characters and longer."""
    return _chunked(items, "raw", NEWS_SEPARATORS, short_as_is=True)


def faqs(page: DataFrame, body: str = "body") -> DataFrame:
    """(seq, title, body): H3 questions and their answers."""
    return page.select(*[c for c in page.columns if c != body], F.inline(_sections(F.col(body), "###")))


def grades(page: DataFrame, body: str = "body") -> DataFrame:
    """(seq, page, type, title, text) of table rows with five cells and more; headers and rules are skipped."""
    lines = page.select(*[c for c in page.columns if c != body], F.posexplode(F.split(F.col(body), "\n")).alias("seq", "line"))
    line = tx.strip(F.col("line"))
    table = F.startswith(line, F.lit("|")) & ~F.contains(line, F.lit("---"))
    for word in GRADE_HEADERS:
        table &= ~F.contains(line, F.lit(word))
    parts = F.split(line, r"\|", -1)
    cells = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), tx.strip)
    rows = lines.where(table).withColumn("cells", cells).where(F.size("cells") >= 5)
    cell = lambda i: F.element_at("cells", i)
    sentence = F.concat(F.lit(GRADE_HEAD), F.concat_ws("，", *[F.concat(F.lit(f"{name}："), cell(i + 1)) for i, name in enumerate(GRADE_FIELDS)]))
    return rows.select(
        *[c for c in page.columns if c != body], "seq", F.lit(GRADE_PAGE).alias("page"), F.lit("grade").alias("type"),
        F.concat(F.lit(GRADE_TITLE), cell(5), F.lit(" "), cell(2)).alias("title"), sentence.alias("text"),
    )


def _field(section: Column, pattern: str) -> Column:
    return tx.strip(F.regexp_extract(section, pattern, 1))


def regulations_and_forms(files: DataFrame) -> DataFrame:
    """Chunks (title, page, chunk_id, chunk, type, category, url, ext) of sections between rules of exactly three dashes."""
    sections = files.select("path", F.posexplode(F.transform(F.split("md", r"\n---\n", -1), tx.strip)).alias("section_no", "section"))
    s = F.col("section")
    fields = {name: (pattern, UNKNOWN if name == "category" else "") for name, pattern in HEADER_FIELDS.items()}
    rows = sections.where(s.rlike(fields["title"][0]))
    rows = rows.withColumns({c: F.coalesce(tx.blank_to_null(_field(s, p)), F.lit(d)) for c, (p, d) in fields.items()})
    body = s
    for pattern, _ in fields.values():
        body = F.regexp_replace(body, pattern, "")
    body = tx.strip(body)
    stand_in = F.concat(F.lit("### Page 1\n"), F.col("title"), F.lit("\n文件類型："), F.col("category"), F.lit("\n來源網址："), F.col("url"))
    rows = rows.withColumn("body", F.when(body == "", stand_in).otherwise(body))
    kind = F.when(F.col("category") == REGULATION, F.lit("regulation")).otherwise(F.lit("form"))
    return _paged(rows.withColumn("type", kind).drop("section"), FORM_SEPARATORS).withColumn("source", F.lit("regulations"))


def regulation_pages(page: DataFrame, body: str = "body") -> DataFrame:
    """Chunks (title, page, chunk_id, chunk) of a page of H2 documents with H3 pages; documents without text are dropped."""
    docs = page.select(*[c for c in page.columns if c != body], F.inline(F.transform(_sections(F.col(body), "##"), lambda d: F.struct(d["seq"].alias("section_no"), d["title"].alias("title"), d["body"].alias("body")))))
    return _paged(docs.where(F.col("body") != ""), REGULATION_SEPARATORS)


def _paged(docs: DataFrame, separators: tuple[str, ...]) -> DataFrame:
    """The H3 pages of each body, or one overview page; empty pages are dropped, chunk ids restart on each page."""
    found = _sections(F.col("body"), "###")
    whole = F.array(F.struct(F.lit(0).alias("seq"), F.lit(OVERVIEW).alias("title"), F.col("body").alias("body")))
    rows = docs.withColumn("p", F.explode(F.when(F.size(found) > 0, found).otherwise(whole)))
    rows = rows.withColumns({"page_seq": F.col("p.seq"), "page": F.col("p.title"), "body": F.col("p.body")}).drop("p").where(F.col("body") != "")
    return _chunked(rows, "body", separators, short_as_is=False)


def _chunked(rows: DataFrame, column: str, separators: tuple[str, ...], short_as_is: bool) -> DataFrame:
    prepare(rows.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunking.split_recursively(t, separators=separators) if not short_as_is or len(t) >= chunking.SIZE else [t])

    return rows.select("*", F.posexplode(cut(column)).alias("chunk_id", "chunk")).drop(column)


def corrections(files: DataFrame) -> DataFrame:
    """(path, seq, dept, text): correction records between blank lines; a missing or unknown department is the first."""
    chunks = files.select("path", F.posexplode(F.split("md", "\n\n", -1)).alias("seq", "chunk")).where(F.contains("chunk", F.lit(CORRECTION_MARK)))
    code = F.lower(F.regexp_extract("chunk", CORRECTION_DEPT, 1))
    return chunks.select("path", "seq", F.when(code.isin(*DEPTS), code).otherwise(F.lit(DEPTS[0])).alias("dept"), tx.strip(F.col("chunk")).alias("text"))


def faq_pairs(files: DataFrame, phrases: list[str]) -> DataFrame:
    """(seq, label, question, answer) of headings like ``### LabelQ1 question``, vague answers dropped."""
    from kelpline.operators.evaluation import vague

    rows = files.select("path", F.inline(_sections(F.col("md"), "###")))
    label, question = (F.regexp_extract("title", r"^(.+?Q\d+)\s+(.+)$", i) for i in (1, 2))
    return rows.where(label != "").select("path", "seq", label.alias("label"), question.alias("question"), F.col("body").alias("answer")).where(~vague(F.col("answer"), phrases))


def regulation_passages(files: DataFrame, titles: Sequence[str], school: str = "", least: int = 200) -> DataFrame:
    """(path, seq, label, passage): the whole text of each listed regulation, labelled by its title without the *school*'s name, from its heading to the next one of
    level one or two, without page marks; the first occurrence below the regulations' heading, if longer than *least*."""
    below = files.select("path", F.when(F.contains("md", F.lit(REGULATIONS_HEADING)), F.substring(F.col("md"), F.instr("md", REGULATIONS_HEADING), F.length("md"))).alias("md"))
    listed = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(t).alias("title")) for i, t in enumerate(titles)])
    rows = below.where(F.col("md").isNotNull()).select("path", "md", F.inline(listed)).withColumn("marker", F.concat(F.lit("## "), "title"))
    rows = rows.where(F.contains("md", F.col("marker")))
    rest = F.substring(F.col("md"), F.position(F.col("marker"), F.col("md")) + F.length("marker"), F.length("md"))
    text = F.concat("marker", F.element_at(F.split(rest, r"\n## |\n# ", 2), 1))
    passage = F.regexp_replace(tx.strip(text), r"### Page [0-9]+\n?", "")
    return rows.select("path", "seq", (F.replace("title", F.lit(school), F.lit("")) if school else F.col("title")).alias("label"), passage.alias("passage")).where(F.length("passage") > least)


def regulation_lines(files: DataFrame) -> DataFrame:
    """(path, seq, title, page, text): runs of non-blank lines below an H2 title, split at H3 pages; lines before the
    first title, and runs without lines, are dropped."""
    lines = files.select("path", F.posexplode(F.split("md", "\n", -1)).alias("line_no", "raw")).withColumn("line", tx.strip(F.col("raw")))
    title = F.startswith("line", F.lit("## "))
    page = F.startswith("line", F.lit("### "))
    upto = Window.partitionBy("path").orderBy("line_no")  # the lines of one file
    marked = lines.withColumns({"file_no": F.sum(title.cast("int")).over(upto), "seq": F.sum((title | page).cast("int")).over(upto)})
    marked = marked.withColumn("name", F.when(title | page, tx.strip(F.regexp_replace("line", "^#+ ", ""))))
    held = F.array_sort(F.collect_list(F.when(~title & ~page & (F.col("line") != ""), F.struct("line_no", "line"))))
    runs = marked.where(F.col("file_no") > 0).groupBy("path", "file_no", "seq").agg(
        F.max(F.when(title, F.col("name"))).alias("own_title"), F.max(F.when(page, F.col("name"))).alias("page"), F.array_join(F.transform(held, lambda r: r["line"]), "\n").alias("text")
    )
    first = F.first("own_title", ignorenulls=True).over(Window.partitionBy("path", "file_no").orderBy("seq"))
    return runs.withColumn("title", first).where((F.col("text") != "") & (F.col("title") != "")).select("path", "seq", "title", F.coalesce(tx.blank_to_null(F.col("page")), F.lit(OVERVIEW)).alias("page"), "text")


def passages(items: DataFrame, least: int, most: int, after: str | None = None) -> DataFrame:
    """News passages for question generation: without lines that only link, long enough, cut to *most* characters."""
    body = F.col("raw")
    if after is not None:
        body = F.when(F.contains(body, F.lit(after)), F.substring_index(body, after, -1)).otherwise(body)
    lines = F.filter(F.split(body, "\n"), lambda s: ~tx.strip(s).rlike(r"^[-*]?\s*\[[^\]]+\]\([^)]+\)$"))
    text = tx.strip(F.array_join(lines, "\n"))
    return items.withColumn("passage", F.substring(text, 1, most)).where(F.length(text) >= least)
