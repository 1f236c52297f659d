"""URL filters by expression expansion and hash-prefix lookup.

A URL becomes a host and a path; every suffix of the host is combined with every path prefix whose length
some rule has. Each expression is digested, equi-joined to the rules on a short prefix of the digest, and the
few rows that meet are confirmed by the full digest. The longest confirmed rule wins.

Defined cases: a null url, or one without ``://``, has an empty host and path and matches no rule; a rule with an
empty path fits every path of its hosts; urls that match none get ``default``; repeated rows give repeated results; an empty table gives none; other columns of
the input play no part, whatever their names. Equal rows are counted, not listed, so a hot url costs a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path); fixed values of the query's contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SHORT = 8  # hex digits of the digest that the join uses
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every host suffix with every path prefix of a length that some rule has."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.array_distinct(F.array(*[F.substring(path, 1, n) for n in lengths]))
    if 0 not in lengths:
        prefixes = F.filter(prefixes, lambda p: F.length(p) > 0)
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    default: str = "allow",
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(key, host, path, rule, verdict) of every row of *pages*. The rules are configuration: a list, so small."""
    spark = pages.sparkSession
    listed = [
        (digest := hashlib.sha256(f"{host}{path}".encode()).hexdigest(), digest[:SHORT], f"{host}{path}", verdict, len(host) + len(path))
        for verdict, host, path in rules
    ]
    known = spark.createDataFrame(listed, "full string, short string, rule string, rule_verdict string, rule_length int")
    lengths = sorted({len(path) for _, _, path in rules}) or [1]
    seen = pages.select(F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # This aggregation deals the rows out once; what follows stays in their partitions.
    counted = seen.groupBy("k", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    expanded = counted.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), lengths)).alias("expression"))
    digested = expanded.withColumn("digest", F.sha2("expression", 256)).withColumn("head", F.substring("digest", 1, SHORT))
    joined = digested.join(F.broadcast(known), digested["head"] == known["short"], "left")
    confirmed = F.when(F.col("digest") == F.col("full"), F.struct("rule_length", "rule", "rule_verdict"))
    best = joined.groupBy("k", "host", "path", "copies").agg(F.max(confirmed).alias("best"))
    rows = best.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select(
        F.col("k").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
    )
