"""Evaluation roll-ups over judged answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions import text as tx


def verdict_rollup(results: DataFrame, depts: tuple[str, ...] | None = None) -> DataFrame:
    """(dept, n, correct, partial, wrong, judge_error, strict, weighted, tool_accuracy), overall (null dept) and by dept.

    Judge errors stay in the denominator; tools are averaged over the rows that expect one.
    """
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    counted = results.groupingSets([[], [F.col("dept")]], F.col("dept")).agg(
        F.count(F.lit(1)).alias("n"),
        is_("CORRECT").alias("correct"),
        is_("PARTIAL").alias("partial"),
        is_("WRONG").alias("wrong"),
        is_("JUDGE_ERROR").alias("judge_error"),
        F.round(F.avg(F.col("tool_hit").cast("double")), 6).alias("tool_accuracy"),
        F.grouping("dept").alias("overall"),
    )
    if depts is not None:
        counted = counted.where((F.col("overall") == 1) | F.col("dept").isin(*depts))
    n = F.col("n")
    return counted.select(
        "dept", "overall", "n", "correct", "partial", "wrong", "judge_error",
        F.round(F.try_divide("correct", n), 6).alias("strict"),
        F.round(F.try_divide(F.col("correct") + F.col("partial") * 0.5, n), 6).alias("weighted"),
        "tool_accuracy",
    )


def latency(results: DataFrame) -> DataFrame:
    """Mean and true median, which averages the middle pair, to one decimal; halves go to the even digit."""
    return results.agg(F.bround(F.avg("latency_s"), 1).alias("mean_s"), F.bround(F.median("latency_s"), 1).alias("median_s"))


def infer_tool(contexts: Column, signatures: dict[str, tuple[str, ...]], default: str) -> Column:
    """The tool with most of its keywords present; ties go to the one declared first, none to *default*."""
    scored = F.array(*[
        F.struct(sum((F.when(F.contains(contexts, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)).alias("hits"), F.lit(-i).alias("order"), F.lit(tool).alias("tool"))
        for i, (tool, words) in enumerate(signatures.items())
    ])
    best = F.array_max(scored)
    return F.when(best["hits"] > 0, best["tool"]).otherwise(F.lit(default))


def adherence(results: DataFrame, meta: DataFrame, phrases: list[str]) -> DataFrame:
    """(id, expected, refused, adherence): on-topic questions should be answered, others refused; on-topic if unknown."""
    met = results.join(meta, "id", "left")
    expected = F.coalesce("topic_adherent", F.lit(True))
    answer = F.coalesce("answer", F.lit(""))
    refused = tx.mentions_any(answer, phrases)
    score = F.when(expected, F.when((answer == "") | refused, 0.0).otherwise(1.0)).otherwise(F.when(refused, 1.0).otherwise(0.0))
    return met.select("id", expected.alias("expected"), refused.alias("refused"), score.alias("adherence"))


def metric_mean(value: Column) -> Column:
    """Mean without nulls and NaN; 0 if nothing is left."""
    return F.coalesce(F.avg(F.nanvl(value, F.lit(None).cast("double"))), F.lit(0.0))


def wrong_subtype(verdict: Column, answer: Column, no_data: list[str]) -> Column:
    """What a wrong answer is: one that found nothing, or one with a wrong fact."""
    return F.when(verdict == "WRONG", F.when(tx.mentions_any(answer, no_data), F.lit("no_data")).otherwise(F.lit("wrong_fact"))).otherwise(F.lit("n/a"))


def scorable(results: DataFrame) -> DataFrame:
    """Rows with an answer, a context and a ground truth; empty ones are missing."""
    return results.where((F.coalesce("answer", F.lit("")) != "") & (F.coalesce(F.size("contexts"), F.lit(0)) > 0) & (F.coalesce("ground_truth", F.lit("")) != ""))


def assign_ids(rows: DataFrame, existing: DataFrame, order: list[Column], prefix: str = "V4") -> DataFrame:
    """Ids that go on from the largest numeric one, in *order*, numbered by offsets of partitions."""
    from kelpline.operators.metadata import dense_ids

    last = existing.agg(F.coalesce(F.max(F.regexp_extract("id", rf"^{prefix}(\d+)$", 1).try_cast("int")), F.lit(0)).alias("last"))  # one row
    keyed = rows.withColumns({f"_order_{i}": c for i, c in enumerate(order)})
    numbered = dense_ids(keyed, [f"_order_{i}" for i in range(len(order))], "_no").join(F.broadcast(last))
    return numbered.select(*rows.columns, F.format_string(f"{prefix}%03d", F.col("last") + F.col("_no") + 1).alias("id"))


def vague(answer: Column, phrases: list[str], least: int = 25) -> Column:
    return (F.length(answer) < least) | tx.mentions_any(answer, phrases)
