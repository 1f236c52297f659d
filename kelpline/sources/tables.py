"""Event logs, question sets, workbooks and configuration."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions import text as tx
from kelpline.operators.metadata import dense_ids
from kelpline.session import prepare

#: The fields of the log's events and their types.
ANSWER = {
    **dict.fromkeys(("event", "severity", "ts", "message_id", "session_id", "dept", "event_type", "language", "question", "answer"), "string"),
    "sources": "array<struct<title: string, url: string>>", "retrieved_titles": "string", "tools": "array<string>", "model": "string", "latency_s": "double",
}
FEEDBACK = {**dict.fromkeys(("event", "severity", "ts", "message_id", "session_id", "rating"), "string"), "reasons": "array<string>", "comment": "string"}


def events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, feedback, corrupt) of a JSON-lines log.

    Blank lines are skipped, lines that are no JSON objects are kept as ``corrupt`` for counting. A field of another type is
    converted where that is possible and null where not; its line stays. Answers need a message id; feedback does not. ``seq`` follows the order of files and lines, for last-write-wins.
    """
    # Files by name, then their splits in order, then lines: Spark itself reads files by size.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    lines = dense_ids(lines.where(tx.strip(F.col("value")) != ""), ["_path", "_block", "_line"], "seq").select("value", "seq")
    # As strings all values parse, whatever their type, so only lines that are no JSON objects are corrupt.
    schema = ", ".join(f"{name} string" for name in (*ANSWER, *(set(FEEDBACK) - set(ANSWER)), "_corrupt_record"))
    parsed = lines.select("seq", "value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"))
    good = parsed.where(F.col("e._corrupt_record").isNull() & F.col("e").isNotNull())
    typed = lambda kinds: [_read(F.col(f"e.{name}"), kind).alias(name) for name, kind in kinds.items()]
    answers = good.where((F.col("e.event") == "answer") & (F.coalesce(F.col("e.message_id"), F.lit("")) != "")).select("seq", *typed(ANSWER))
    feedback = good.where(F.col("e.event") == "feedback").select("seq", *typed(FEEDBACK))
    return answers, feedback, parsed.where(F.col("e._corrupt_record").isNotNull() | F.col("e").isNull()).select("seq", "value")


def _read(text: Column, kind: str) -> Column:
    """A field of that type from its JSON text; null if it is of another type."""
    if kind.startswith("array"):
        return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, kind))
    return text if kind == "string" else text.try_cast(kind)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def json_array(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Rows of a JSON array file by key, the last of each; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(path, multiLine=True).select("*", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("_no"))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_no")))
    return rows.withColumn("_last", last).where(F.col("_last") == 1).drop("_no", "_last")


def workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(row_no, cells map) of a sheet of an xlsx file; empty where the file or the sheet is missing or the file is no workbook.

    Workbooks are small and read by one task each, as the format needs.
    """
    from kelpline.sources import xlsx

    schema = "row_no long, cells map<string,string>"
    prepare(spark)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                lines = xlsx.sheet_rows(content, sheet)
                names = next(lines, [])
                made = [(i, {n: v for n, v in zip(names, line) if n and v}) for i, line in enumerate(lines)]
                yield pd.DataFrame(made, columns=["row_no", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def regulation_metadata(cells: DataFrame, dept_label: str | None = None) -> DataFrame:
    """(title_norm, url, category, type, date) of a workbook's rows, the last row of each title.

    Without a label the sheet has English headers; with one it has Chinese headers and is filtered by department.
    """
    get = lambda name: F.coalesce(tx.strip(F.element_at("cells", F.lit(name))), F.lit(""))
    names = ("title", "tags", "updated_date", "file_url", "source_page") if dept_label is None else ("法規名稱", "標籤", "上傳日期", "檔案連結", "網址")
    title, tags, date, url, other = map(get, names)
    rows = cells if dept_label is None else cells.where(get("處室") == dept_label)
    kind = tx.tag_kind(tags)
    named = rows.where(title != "").select("row_no", tx.title_key(title).alias("title_norm"), F.struct(F.coalesce(tx.blank_to_null(url), other).alias("url"), kind["category"].alias("category"), kind["type"].alias("type"), date.alias("date")).alias("meta"))
    return named.groupBy("title_norm").agg(F.max_by("meta", "row_no").alias("meta")).select("title_norm", "meta.*")


def config(text: str, env: dict[str, str] | None = None, comments: bool = False) -> dict[str, str]:
    """``key=value`` lines split at the first ``=``; the file overrides the environment."""
    out = dict(os.environ if env is None else env)
    for line in text.splitlines():
        if "=" in line and not (comments and line.lstrip().startswith("#")):
            name, _, value = line.partition("=")
            out[name.strip()] = value.strip()
    return out


def resolve(name: str, folders: list[str]) -> str:
    """The first folder's file that exists, else the first folder's path."""
    paths = [os.path.join(folder, name) for folder in folders]
    return next((p for p in paths if os.path.exists(p)), paths[0])
