"""Connected components by spreading least labels with pointer jumping; all state stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.session import Scratch

ROWS_PER_PART = 200_000


def connected(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every end of *edges*: the least node that it reaches. Tables are kept in *scratch*.

    Each round takes the least label among the neighbours and then the label's own label, so labels
    travel many edges in a round. Every table that is joined is stored first, which lets adaptive execution
    split the part of a node with very many edges. Null ends are ignored; loops and repeats do no harm.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    ways = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = scratch.cut(ends.select(F.inline(ways)).distinct())
    lots = 1 + both.count() // ROWS_PER_PART  # a stored table's count reads no rows
    cut = lambda df: scratch.cut(df.coalesce(lots))  # noqa: E731  few rows need few files
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    total = None
    while True:
        told = both.join(labels, both["u"] == labels["node"]).select(F.col("v").alias("node"), "label")
        spread = cut(told.union(labels).groupBy("node").agg(F.min("label").alias("label")))
        further = spread.select(F.col("node").alias("at"), F.col("label").alias("next"))
        labels = cut(spread.join(further, spread["label"] == further["at"]).select("node", F.col("next").alias("label")))
        before, total = total, labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:  # labels only ever fall
            return labels.select("node", F.col("label").alias("component"))
