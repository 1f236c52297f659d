"""The tool surface: named table functions over the knowledge base, dispatched by name with JSON arguments."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import lookup, retrieval
from kelpline.operators.models import Models, Offline
from kelpline.sources import sinks


@dataclass
class Knowledge:
    """What the tools look at: documents, the vectors (doc_id, vector) they have, and where corrections go."""

    docs: DataFrame
    vectors: DataFrame | None = None
    corrections: str | None = None
    models: Models | None = None
    dept: str | None = None


def search(base: Knowledge, search_query: str = "", k: int = 6, vector: list[float] | None = None) -> DataFrame:
    """Retrieval of one query, reranked, with the documents' columns; without vectors the lexical list stands alone."""
    docs, models = base.docs, base.models or Offline()
    spark = docs.sparkSession
    asked = spark.createDataFrame([(0, search_query, vector)], "query_id long, query string, vector array<double>")
    if base.vectors is not None:
        found = retrieval.retrieve(docs, base.vectors, asked, models, k, dept=base.dept)
    else:
        found = retrieval.bm25(docs, asked, 3 * k, among=None if base.dept is None else F.col("dept") == base.dept)
        met = found.join(docs.select("doc_id", "text"), "doc_id").join(F.broadcast(asked), "query_id")  # one query
        found = retrieval.rerank(met, models.relevance(F.col("query"), F.col("text")), k).select("query_id", "position", "doc_id", "rerank_score")
    return found.drop("query_id").join(docs, "doc_id").orderBy("position")


def news(base: Knowledge, keyword: str = "") -> DataFrame:
    rows = base.docs.where(F.col("type") == "news")
    return lookup.keyword_news(rows, keyword, 6, base.dept) if keyword else lookup.latest_news(rows, 6, base.dept)


def record(base: Knowledge, original_query: str = "未知問題", correction_info: str = "", relevant: bool = True) -> DataFrame:
    """Records a correction that the gate lets through; (recorded) tells whether it did."""
    spark = base.docs.sparkSession
    row = spark.createDataFrame([(base.dept, original_query, correction_info)], "dept string, topic string, text string")
    if base.corrections is not None:
        sinks.record_corrections(row, F.lit(relevant), base.corrections)
    return spark.createDataFrame([(relevant and base.corrections is not None,)], "recorded boolean")


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "get_latest_news": news,
    "get_schedule": lambda base, year=None: lookup.schedule(base.docs, year),
    "get_competition_records": lambda base, **a: lookup.find_records(base.docs.where(F.col("type") == "grade"), **a),
    "search_regulations_and_general": search,
    "record_correction": record,
    "find_forms": lambda base, keyword="": lookup.find_forms(base.docs.where(F.col("category") == "表單"), keyword),
}

#: Arguments of each tool by kind, and those it needs: fixed values of the tool surface.
SCHEMAS: dict[str, tuple[dict[str, type], tuple[str, ...]]] = {
    "get_latest_news": ({"keyword": str}, ()),
    "get_schedule": ({"year": int}, ()),
    "get_competition_records": ({"keyword": str, "year": str, "name": str}, ()),
    "search_regulations_and_general": ({"search_query": str}, ("search_query",)),
    "record_correction": ({"original_query": str, "correction_info": str}, ("original_query", "correction_info")),
    "find_forms": ({"keyword": str}, ()),
}


def schema_of(name: str) -> dict:
    """A tool's arguments as JSON schema."""
    kinds, needed = SCHEMAS[name]
    properties = {a: {"type": "integer" if kind is int else "string"} for a, kind in kinds.items()}
    return {"type": "object", "properties": properties, **({"required": list(needed)} if needed else {})}


def parse(name: str, arguments: str | None) -> dict:
    """A call's arguments from JSON: what is no object is an empty one; arguments that the tool has not, and values
    of another kind, are left out, but digits are a number where one is wanted and a number is text where that is."""
    try:
        given = json.loads(arguments or "{}")
    except ValueError:
        given = {}
    kinds = SCHEMAS.get(name, ({}, ()))[0]
    given = {a: _as(v, kinds[a]) for a, v in given.items() if a in kinds} if isinstance(given, dict) else {}
    return {a: v for a, v in given.items() if v is not None}


def _as(value, kind: type):
    if isinstance(value, str) and kind is int:
        return int(value) if re.fullmatch(r"\s*[+-]?[0-9]+\s*", value) else None
    if isinstance(value, int) and kind is str and not isinstance(value, bool):
        return str(value)
    return value if isinstance(value, kind) and not isinstance(value, bool) else None


def call(base: Knowledge | DataFrame, name: str, arguments: dict | str | None = None) -> DataFrame:
    """The rows that a tool finds; an unknown tool finds none."""
    base = base if isinstance(base, Knowledge) else Knowledge(base)
    tool = TOOLS.get(name)
    if tool is None:
        return base.docs.limit(0)
    return tool(base, **(arguments if isinstance(arguments, dict) else parse(name, arguments)))


def register(spark: SparkSession, base: Knowledge, prefix: str = "kb_") -> list[str]:
    """Temporary views of what the tools find without arguments, for SQL; their names."""
    names = []
    for name in ("get_latest_news", "get_schedule", "find_forms"):
        call(base, name).createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names
