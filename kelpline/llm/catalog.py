"""The queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from kelpline.llm import query_defs

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**query_defs.QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {**query_defs.ORACLE_SQL, **own}
