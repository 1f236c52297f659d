"""Steps that need a language model: a typed interface and deterministic offline stand-ins.

The stand-ins are plain text rules, never presented as model output; what surrounds a model (parsing,
defaults, truncation) is the same for both.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions import text as tx
from kelpline.operators.retrieval import overlap_score

#: Departments in the order in which a router's reply is searched for them.
ROUTES = ("inject", "other", "chat", "oaa", "osa", "ope", "lc", "ge")


class Models(Protocol):
    def rewrites(self, query: Column) -> Column: ...

    def passage(self, query: Column) -> Column: ...

    def embed(self, text: Column, own: Column) -> Column: ...

    def relevance(self, query: Column, body: Column) -> Column: ...

    def route_reply(self, question: Column) -> Column: ...

    def judge_reply(self, answer: Column, truth: Column) -> Column: ...


class Offline:
    """Stand-ins: no rewrite, the query as its own passage, its stored vector for any text, token overlap as relevance and as judgement."""

    def rewrites(self, query: Column) -> Column:
        return F.array(query)

    def passage(self, query: Column) -> Column:
        return query

    def embed(self, text: Column, own: Column) -> Column:
        return own

    def relevance(self, query: Column, body: Column) -> Column:
        return overlap_score(query, body)

    def route_reply(self, question: Column) -> Column:
        return F.lit("ope")

    def judge_reply(self, answer: Column, truth: Column) -> Column:
        share = overlap_score(truth, answer, None)
        return F.when(share >= 0.8, "CORRECT").when(share >= 0.4, "PARTIAL").otherwise("WRONG")


def route(reply: Column, order: tuple[str, ...] = ROUTES, default: str = "ope") -> Column:
    """The first department that the reply names, else *default*."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    out = F.lit(default)
    for name in reversed(order):
        out = F.when(F.contains(low, F.lit(name)), F.lit(name)).otherwise(out)
    return out


def verdict(reply: Column) -> Column:
    """The judge's verdict, or JUDGE_ERROR for a reply without one."""
    found = F.regexp_extract(F.upper(F.coalesce(reply, F.lit(""))), r"(CORRECT|PARTIAL|WRONG)", 1)
    return F.coalesce(tx.blank_to_null(found), F.lit("JUDGE_ERROR"))


def clamp(score: Column, failed: float = 0.5) -> Column:
    """A score within 0 and 1; *failed* where there is none."""
    return F.when(score.isNull() | F.isnan(score), F.lit(failed)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))  # these two skip nulls


def yes(reply: Column, default: bool = False) -> Column:
    """Whether a reply begins with y."""
    return F.coalesce(F.startswith(F.lower(reply), F.lit("y")), F.lit(default))


def ordinal_pick(items: Column, position: Column) -> Column:
    """The item at a position from 1 to 10, else the last."""
    inside = (position >= 1) & (position <= F.least(F.lit(10), F.size(items)))
    return F.when(inside, F.get(items, position - 1)).otherwise(F.try_element_at(items, F.lit(-1)))


def tool_arguments(arguments: Column, schema: str) -> Column:
    """Tool arguments from JSON; anything that does not parse is an empty object."""
    return F.coalesce(F.from_json(arguments, schema), F.from_json(F.lit("{}"), schema))


def rewrites_of(reply: Column, query: Column) -> Column:
    """The rewrites in a reply, one a line; a model that failed (null) leaves the query."""
    lines = F.filter(F.transform(F.split(reply, "\n"), tx.strip), lambda line: line != "")
    return F.when(reply.isNull(), F.array(query)).otherwise(lines)


def passage_of(reply: Column, query: Column) -> Column:
    """A hypothetical passage; a model that failed leaves the query."""
    return F.coalesce(reply, query)


def scores_of(reply: Column) -> Column:
    """Rerank scores from a JSON array; null for a reply that is none, after which the fused order stays."""
    return F.from_json(reply, "array<double>")


def injected(reply: Column) -> Column:
    """Whether the classifier takes a question for an attack on the system's rules; one that fails lets it pass."""
    return yes(reply, False)


def relevant_correction(reply: Column) -> Column:
    """Whether a correction is about the department; a classifier that fails rejects it."""
    return yes(reply, False)


#: Phrases of refusals, and stand-ins for services that failed.
REFUSALS = ("無法找到", "很抱歉", "查無", "無相關資訊")
NO_TRANSCRIPT = "（語音轉寫失敗）"
NO_RESULT = "未知工具或查無資訊。"
FALLBACK_HEAD = "我目前先找到以下較相關的資訊，提供您參考：\n"
FALLBACK_TAIL = "\n如果您想找的是申請表、借用單、法規或公告，我也可以依照關鍵字再幫您縮小範圍。"
FALLBACK_NONE = "目前這個問題我暫時沒有查到明確答案，但如果您換成更具體的關鍵字，例如表單名稱、場地名稱、公告主題或法規名稱，我比較能整理出可用資訊。"


def completeness(answer: Column, truth: Column, reply: Column) -> Column:
    """A judged share of the facts: 0 without answer or truth, 0.1 for a refusal, 0.5 where the judge failed, else
    the first number of the reply, clamped."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused |= F.contains(answer, F.lit(phrase))
    number = F.regexp_extract(F.coalesce(reply, F.lit("")), r"[0-9.]+", 0).try_cast("double")
    return F.when(blank(truth) | blank(answer), 0.0).when(refused, 0.1).otherwise(F.bround(clamp(number), 4))


def transcript(reply: Column) -> Column:
    return F.coalesce(reply, F.lit(NO_TRANSCRIPT))


def spoken_summary(reply: Column, answer: Column, most: int = 200) -> Column:
    """A summary for speech; without one, the beginning of the answer without marks and links."""
    bare = F.regexp_replace(answer, r"[#*`>\[\]!]|https?://\S+", "")
    return F.coalesce(reply, tx.strip(F.substring(bare, 1, most)))


def generated_pairs(replies: DataFrame, phrases: list[str], reply: str = "reply", question: str | None = None) -> DataFrame:
    """The columns of *replies* with (question, ground_truth) of each pair in the first JSON array of a reply; replies
    without one bring none, vague truths are dropped, and with *question* so are pairs that repeat it."""
    from kelpline.operators.evaluation import vague

    array = F.regexp_extract(F.col(reply), r"(?s)\[.*\]", 0)
    rows = replies.withColumn("_pair", F.explode(F.from_json(array, "array<struct<question: string, ground_truth: string>>")))
    asked, truth = (tx.strip(F.coalesce(F.col(f"_pair.{c}"), F.lit(""))) for c in ("question", "ground_truth"))
    kept = (asked != "") & ~vague(truth, phrases)
    if question is not None:
        kept &= asked != tx.strip(F.col(question))
    else:
        kept &= truth != ""
    return rows.where(kept).select(*[c for c in replies.columns if c not in (reply, "question", "ground_truth")], asked.alias("question"), truth.alias("ground_truth"))


def agent_rounds(calls: DataFrame, most: int = 4) -> DataFrame:
    """Tool calls (conv, round, seq, ...) that an agent may make: *most* rounds, of which the last has no tools."""
    return calls.where(F.col("round") < most - 1)


def fallback_answer(listing: Column) -> Column:
    """What is said when the agent failed: the listing of what plain retrieval found, if anything."""
    found = F.concat(F.lit(FALLBACK_HEAD), F.lit("\n"), listing, F.lit("\n"), F.lit(FALLBACK_TAIL))
    return F.when(F.coalesce(listing, F.lit("")) == "", F.lit(FALLBACK_NONE)).otherwise(found)
