"""An inverted index that follows its files: what changed is found by digests and indexed anew, the rest stays.

Files belong to one of GROUPS groups by a hash of their path. A group's digest is made of its files' digests, the root's
of the groups'. A refresh compares them from the root down; only groups with an added, changed or removed file are
read again, and their cells and bounds are stored as a new generation. A group's older generations are dead from then
on; document frequencies are carried over by the difference between the group's old and new cells. Dead cells are left
out by the table of groups, which has GROUPS rows at most. When more than half of the cells are dead, the next refresh
writes everything anew.

A group's documents are all documents of its files, so ``docs`` must tell which file each is of. Null texts are empty;
files without documents have a digest all the same; without any change nothing is written. Impact bounds hold for the
mean length of their generation; when it grows they are stretched by as much, which keeps them bounds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kelpline.operators import inverted
from kelpline.operators.inverted import Inverted

GROUPS = 1024
BOUNDS = "cell long, term string, n long, top double, bucket int"
SPAN = 256  # generations that are told apart in the number of a cell


def group_of(path: Column, groups: int = GROUPS) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(groups)).cast("int")


def digests(files: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(group, digest): of each group's files (path, content), whatever their order."""
    one = F.sha2(F.encode(F.concat_ws("\x00", F.coalesce("path", F.lit("")), F.coalesce("content", F.lit(""))), "utf-8"), 256)
    half = lambda digest, start: F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    own = files.select(group_of(F.col("path"), groups).alias("group"), one.alias("one"))
    return own.groupBy("group").agg(F.sha2(F.encode(F.concat_ws("|", F.count(F.lit(1)).cast("string"), half("one", 1), half("one", 16), half("one", 31)), "utf-8"), 256).alias("digest"))


class Refreshed:
    """The index stored under *path*; *keep* are columns of the documents for filters."""

    def __init__(self, spark: SparkSession, path: str, keep: Sequence[str] = (), groups: int = GROUPS, cell_docs: int = inverted.CELL_DOCS):
        self.spark, self.path, self.keep, self.groups, self.cell_docs = spark, path.rstrip("/"), list(keep), groups, cell_docs

    def _state(self) -> dict:
        """Generation, the groups' digests and generations, cells by generation: one line, written last."""
        from kelpline.sources.tables import exists

        if not exists(self.spark, f"{self.path}/state"):
            return {"generation": -1, "digests": {}, "live": {}, "root": "", "cells": 0, "dead": 0, "means": {}, "floor": 0.0}
        return json.loads(self.spark.read.text(f"{self.path}/state").first().value)

    def refresh(self, files: DataFrame, docs: Callable[[DataFrame], DataFrame]) -> dict:
        """Brings the index up to *files* (path, content); *docs* makes (path, doc_id, text, *keep) of files. Tells how many groups
        there are and how many were read again."""
        state = self._state()
        found = {str(r["group"]): r.digest for r in digests(files, self.groups).collect()}  # GROUPS at most
        root = _root(found)
        if root == state["root"]:
            return {"groups": len(found), "read": 0}
        oldest = min(state["live"].values(), default=state["generation"])
        again = state["dead"] * 2 > state["cells"] + 1 or state["generation"] - oldest > SPAN - 2
        changed = {g for g in {*found, *state["digests"]} if again or found.get(g) != state["digests"].get(g)}
        generation = state["generation"] + 1
        place = f"{self.path}/generation={generation}"
        listed = [int(g) for g in changed]
        own = docs(files.where(group_of(F.col("path"), self.groups).isin(listed))).withColumn("group", group_of(F.col("path"), self.groups))

        def store(name: str, df: DataFrame, by: Sequence[str]) -> DataFrame:
            df.write.mode("overwrite").options(**inverted.WRITTEN).parquet(f"{place}/{name}", partitionBy=list(by) or None)
            return self.spark.read.schema(df.schema).parquet(f"{place}/{name}")

        built = inverted.build(own, store, keep=[*self.keep, "group"], cell_docs=self.cell_docs)
        cells, n, tokens = built.sizes()
        old = self._cells(state).where(F.col("group").isin(listed)) if state["live"] and not again else None
        gone = old.count() if old is not None else 0
        delta = _frequencies(built.cells)
        if old is not None:
            delta = self.spark.read.parquet(f"{self.path}/terms/{state['generation']}").select("term", "df").unionByName(delta).unionByName(_frequencies(old).withColumn("df", -F.col("df")))
        terms = delta.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") > 0)
        live = {g: s for g, s in state["live"].items() if g not in changed} | {g: generation for g in changed if g in found}
        means = {k: v for k, v in state["means"].items() if int(k) in live.values()} | {str(generation): tokens / (n or 1)}
        new = {"generation": generation, "digests": found, "live": live, "root": root, "cells": cells if again else state["cells"] + cells, "dead": 0 if again else state["dead"] + gone, "means": means}
        whole = self._cells(new).agg(F.sum("n_docs")).first()[0] or 0
        raw = terms.withColumn("raw", F.ln((F.lit(whole) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        raw.write.mode("overwrite").parquet(f"{self.path}/terms/{generation}")
        new["floor"] = (self.spark.read.parquet(f"{self.path}/terms/{generation}").agg(F.avg("raw")).first()[0] or 0.0) * inverted.EPSILON
        self.spark.createDataFrame([(json.dumps(new),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/state")
        return {"groups": len({*found, *state["digests"]}), "read": len(changed)}

    def _live(self, state: dict, name: str, more: Callable[[DataFrame, int], DataFrame] = lambda df, _: df) -> DataFrame:
        """The rows of the groups' live generations."""
        out = None
        for generation in sorted({*state["live"].values()} or {state["generation"]}):
            groups, place = [int(g) for g, s in state["live"].items() if s == generation], f"{self.path}/generation={generation}"
            cells = self.spark.read.parquet(f"{place}/cells")
            kept = [cells.schema[c] for c in (*self.keep, "group")]
            rows = cells if name == "cells" else self.spark.read.schema(StructType([*kept, *StructType.fromDDL(BOUNDS).fields])).parquet(f"{place}/{name}")
            own = more(rows.where(F.col("group").isin(groups)), generation)
            own = own.withColumn("cell", F.col("cell") + F.lit((generation % SPAN) << 54))
            out = own if out is None else out.unionByName(own)
        return out

    def _cells(self, state: dict) -> DataFrame:
        return self._live(state, "cells")

    def index(self) -> Inverted:
        """The index as it is now, for ``inverted.search``."""
        state = self._state()
        cells = self._cells(state)
        _, n, tokens = Inverted(cells, cells, cells).sizes()
        mean = tokens / (n or 1)
        stretched = lambda df, g: df.withColumn("top", F.col("top") * max(1.0, mean / (state["means"][str(g)] or 1.0)) if state["means"][str(g)] else F.col("top"))
        raw = self.spark.read.parquet(f"{self.path}/terms/{state['generation']}")
        terms = raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(state["floor"])).otherwise(F.col("raw")).alias("idf"))
        return Inverted(self._live(state, "bounds", stretched), cells, terms)


def _root(found: dict[str, str]) -> str:
    import hashlib

    return hashlib.sha256("|".join(f"{g}:{d}" for g, d in sorted(found.items())).encode()).hexdigest()


def _frequencies(cells: DataFrame) -> DataFrame:
    """(term, df) of some cells."""
    counts = F.transform("ends", lambda e, i: e - F.when(i > 0, F.get("ends", i - 1)).otherwise(F.lit(0)))
    listed = cells.where(F.col("terms") != "").select(F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), counts.alias("n"))).alias("t"))
    return listed.groupBy(F.col("t.term").alias("term")).agg(F.sum("t.n").cast("long").alias("df"))
