"""Sinks: logs, events, caches and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators.metadata import dense_ids


def append_csv(rows: DataFrame, path: str, enabled: bool = True) -> None:
    """Appends to a folder of CSV parts, each with its header; nothing where logs are kept elsewhere."""
    if enabled:
        rows.write.mode("append").option("header", True).csv(path)


def event_line(rows: DataFrame, event: str, at: Column | None = None) -> DataFrame:
    """(value): the JSON line of each row, text columns without empty values; *at* is the event's time, if given."""
    stamp = [] if at is None else [F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts")]
    kept = [F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(F.lit(event).alias("event"), F.lit("INFO").alias("severity"), *stamp, *kept)).alias("value"))


def load_or_build(spark: SparkSession, path: str, fingerprint: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table stored at *path* if it was built from the same contents, else a new one, stored there.

    The fingerprint is stored after the table, so an interrupted build is never taken for a whole one.
    """
    try:
        stored = spark.read.parquet(f"{path}/fingerprint").first()
    except Exception as missing:  # a path that is not there
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = None
    if stored is None or stored[0] != fingerprint:
        build().write.mode("overwrite").parquet(f"{path}/table")
        spark.createDataFrame([(fingerprint,)], "fingerprint string").coalesce(1).write.mode("overwrite").parquet(f"{path}/fingerprint")
    return spark.read.parquet(f"{path}/table")


def append_summary(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Old and new summary rows; columns that one lacks are null."""
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def write_metric(rows: DataFrame, path: str) -> None:
    """A metric's rows as CSV with a header that begins with a byte-order mark, as spreadsheets want it."""
    marked = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    marked.write.mode("overwrite").option("header", True).csv(path)


def read_metric(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_metric`` wrote, as text columns."""
    rows = spark.read.csv(path, header=True)
    return rows.toDF(*[c.removeprefix("\ufeff") for c in rows.columns])


def write_results(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """Results and their summary as JSON; called again with more rows, it replaces what it wrote."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_in_steps(rows: DataFrame, summarise: Callable[[DataFrame], DataFrame], order: str, path: str, every: int = 10) -> None:
    """Results (judged by a slow model, so few) appended by tens in *order*, with their summary after each step: an
    interrupted run goes on after the rows it has written."""
    spark = rows.sparkSession
    numbered = dense_ids(rows, [order], "_no")
    total, done = numbered.count(), 0
    try:
        done = spark.read.schema(rows.schema).json(f"{path}/rows").count()
    except Exception as missing:  # a path that is not there
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    for start in range(done, total, every):
        numbered.where((F.col("_no") >= start) & (F.col("_no") < start + every)).drop("_no").write.mode("append").json(f"{path}/rows")
        summarise(spark.read.schema(rows.schema).json(f"{path}/rows")).write.mode("overwrite").json(f"{path}/summary")


#: Departments by code, and the lines of a correction record.
DEPT_NAMES = {"ope": "體育室", "ge": "通識教育中心", "lc": "語言中心", "oaa": "教務處", "osa": "學務處"}
CORRECTION_LINES = ("## 修正紀錄：", "- **所屬處室**：", "- **相關問題/主題**：", "- **正確資訊**：")


def correction_record(dept: Column, topic: Column, text: Column, at: Column) -> Column:
    """One record in Markdown, as ``markdown.corrections`` reads it; an unknown department becomes the first. Blank
    lines, which end a record, are closed up."""
    code = F.lower(F.coalesce(dept, F.lit("")))
    first = next(iter(DEPT_NAMES))
    code = F.when(code.isin(*DEPT_NAMES), code).otherwise(F.lit(first))
    name = F.element_at(F.create_map(*[F.lit(x) for pair in DEPT_NAMES.items() for x in pair]), code)
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\n(\s*\n)+", "\n")
    values = (F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.concat(code, F.lit("（"), name, F.lit("）")), flat(topic), flat(text))
    return F.concat(*[x for mark, value in zip(CORRECTION_LINES, values) for x in (F.lit(mark), value, F.lit("\n"))])


def record_corrections(rows: DataFrame, relevant: Column, path: str, at: Column | None = None) -> None:
    """Appends (dept, topic, text) records that the gate lets through to a folder of Markdown files."""
    kept = rows.where(F.coalesce(relevant, F.lit(False)))
    kept.select(correction_record(F.col("dept"), F.col("topic"), F.col("text"), F.current_timestamp() if at is None else at)).write.mode("append").text(path)
