"""The agent loop over many conversations at once.

Each round asks the model about every conversation that is still open, takes the calls it makes apart by tool, answers
all calls of a tool in one bulk job, and puts the results back in their conversations in the order of the calls. A reply
without calls is the answer. After ROUNDS rounds, the last of which has no tools, every conversation is closed. A
conversation for which the model fails gets what plain retrieval finds, listed. The conversations' state is stored
after each round; nothing of it passes through the driver.

Null arguments, and arguments that are no JSON object, count as none; an unknown tool finds nothing; calls without an
id get one of round and place; calls made in the last round are not answered; repeated ids of conversations are
one conversation, of the least query; an empty table gives no rows.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from kelpline.functions import text as tx
from kelpline.operators import bulk, lookup, render, retrieval
from kelpline.operators.models import Models, Offline, fallback_answer
from kelpline.session import Scratch

ROUNDS = 4
CALL = "array<struct<id: string, name: string, arguments: string>>"
MESSAGE = StructType([StructField(n, StringType()) for n in ("role", "name", "call_id", "content")])
#: What tools say.
NO_SCHEDULE, NO_NEWS, NO_HITS, UNKNOWN_TOOL = "查無相關課表資訊。", "查無最新消息。", "目前沒有檢索到高度相關的文件內容。", "未知工具或查無資訊。"
NO_FORMS, FORMS_HEAD = "目前沒有直接匹配到相關表單，請嘗試以更具體的場地名稱或表單類型作為關鍵字重新查詢。", "### 相關表單與連結\n"
HITS_HEAD = "請根據以下文件內容回答，優先使用原文重點，不要自行擴寫：\n\n"
OTHER_YEAR = ("（找不到 ", " 年的課表，以下為最新一版）\n\n")
NO_RECORDS = ("查無符合條件的競賽成績 (關鍵字:", ", 年份:", ", 姓名:", ")。請確認年份、項目或姓名是否正確。")
RECORDS, RECORDS_CUT, RECORDS_MORE = ("為您找到 ", " 筆成績紀錄"), "（僅顯示前 {n} 筆以節省版面）", ("\n\n*(提示：還有 ", " 筆未顯示，請加上特定項目或人名來縮小範圍)*")
RELAXED = "（查無完全符合關鍵字的紀錄，以下為放寬條件後的結果）\n"
RECORDED, NOT_RECORDED = "已記錄修正資訊。", "修正資訊未被記錄。"


class Agent(Protocol):
    """A model that talks: for each conversation (conv_id, query, round, messages) its reply (conv_id, content, calls, failed);
    *tools* tells whether it may call any."""

    def reply(self, open_: DataFrame, tools: bool) -> DataFrame: ...


def _argument(name: str) -> Column:
    return F.coalesce(F.element_at("arguments", F.lit(name)), F.lit(""))


def _said(found: DataFrame, calls: DataFrame, otherwise: Column) -> DataFrame:
    """(call, content) of all *calls*; *otherwise* where nothing was found."""
    return calls.join(found, "call", "left").select("call", F.coalesce("text", otherwise).alias("content"))


def _news(docs: DataFrame, calls: DataFrame, n: int = 6) -> DataFrame:
    rows = docs.where(F.col("type") == "news")
    asked = calls.select(F.col("call").alias("request_id"), _argument("keyword").alias("query"), "dept")
    named = bulk.keyword_news(rows, asked.where(F.col("query") != ""), n).select("request_id", "position", "doc_id")
    latest = asked.where(F.col("query") == "").select("request_id", "dept")
    every = rows.select("doc_id", "title", "date", F.lit(None).cast("string").alias("dept")).unionByName(rows.where(F.col("dept").isNotNull()).select("doc_id", "title", "date", "dept"))
    newest = _newest(every, n)
    met = latest.join(newest, latest["dept"].eqNullSafe(newest["dept"])).select("request_id", "position", "doc_id")
    hits = named.unionByName(met).join(rows.select("doc_id", "title", "date", "text"), "doc_id").withColumn("rank", F.col("position"))
    return _said(render.news_list(hits, "request_id").withColumnRenamed("request_id", "call"), calls, F.lit(NO_NEWS))


def _newest(rows: DataFrame, n: int) -> DataFrame:
    """(dept, position, doc_id): the newest row of each title, the first *n* of each department."""
    from pyspark.sql import Window

    order = [F.desc("date"), F.asc("doc_id")]
    one_each = rows.withColumn("_place", F.row_number().over(Window.partitionBy("dept", "title").orderBy(*order))).where(F.col("_place") == 1)
    return one_each.withColumn("position", F.row_number().over(Window.partitionBy("dept").orderBy(*order))).where(F.col("position") <= n).select("dept", "position", "doc_id")


def _schedule(docs: DataFrame, calls: DataFrame) -> DataFrame:
    """The newest schedule for each call, of its year if one names it."""
    year = _argument("year").try_cast("int")
    asked = calls.select("call", F.nullif(year, F.lit(0)).alias("year"))
    found = docs.where(tx.is_schedule(F.col("title"), F.col("text"))).select("doc_id", "title", "text", "date", "source")
    order = F.struct(F.coalesce("date", F.lit("")).alias("d"), (-F.col("doc_id")).alias("i"))
    newest = found.agg(F.max_by(F.struct("title", "text", "date", "source"), order).alias("any"))  # one row
    years = [r.year for r in asked.where(F.col("year").isNotNull()).select("year").distinct().limit(1000).collect()]
    exact = [tx.names_year(F.col("title"), F.col("text"), F.col("date"), y) for y in years]
    named = found.withColumn("year", F.explode(F.array_compact(F.array(*[F.when(e, F.lit(y)) for e, y in zip(exact, years)]).cast("array<int>"))))
    by_year = named.groupBy("year").agg(F.max_by(F.struct("title", "text", "date", "source"), order).alias("own"))
    met = asked.join(by_year, "year", "left").crossJoin(F.broadcast(newest)).where(F.col("any").isNotNull())  # one row
    picked = met.select("call", F.lit(1).alias("rank"), F.coalesce("own", "any").alias("d"), F.when(F.col("year").isNotNull() & F.col("own").isNull(), F.concat(F.lit(OTHER_YEAR[0]), F.col("year").cast("string"), F.lit(OTHER_YEAR[1]))).alias("head"))
    lines = render.bullet_list(picked.select("call", "rank", "d.*"), "call").join(picked.select("call", "head"), "call")
    return _said(lines.select("call", F.concat(F.coalesce("head", F.lit("")), "text").alias("text")), calls, F.lit(NO_SCHEDULE))


def _records(docs: DataFrame, calls: DataFrame, most: int = 25) -> DataFrame:
    rows = docs.where(F.col("type") == "grade")
    asked = calls.select(F.col("call").alias("request_id"), *[_argument(a).alias(a) for a in ("keyword", "year", "name")])
    found = bulk.find_records(rows, asked, most).join(rows.select("doc_id", "text"), "doc_id").withColumn("rank", F.col("position"))
    lists = render._joined(found, "request_id", F.coalesce("text", F.lit("")), "\n")
    totals = found.groupBy("request_id").agg(F.first("total").alias("total"), F.first("mode").alias("mode"))
    total = F.col("total").cast("string")
    cut, strict = F.col("total") > most, F.col("mode") == "strict"
    head = F.concat(F.when(strict, F.lit("")).otherwise(F.lit(RELAXED)), F.lit(RECORDS[0]), total, F.lit(RECORDS[1]), F.when(cut, F.lit(RECORDS_CUT.format(n=most))).otherwise(F.lit("")), F.lit("：\n"))
    tail = F.when(cut, F.concat(F.lit(RECORDS_MORE[0]), (F.col("total") - most).cast("string"), F.lit(RECORDS_MORE[1]))).otherwise(F.lit(""))
    texts = lists.join(totals, "request_id").select(F.col("request_id").alias("call"), F.concat(head, "text", tail).alias("text"))
    none = F.concat(F.lit(NO_RECORDS[0]), _argument("keyword"), F.lit(NO_RECORDS[1]), _argument("year"), F.lit(NO_RECORDS[2]), _argument("name"), F.lit(NO_RECORDS[3]))
    return _said(texts, calls, none)


def _forms(docs: DataFrame, calls: DataFrame) -> DataFrame:
    rows = docs.where(F.col("category") == "表單")
    found = bulk.find_forms(rows, calls.select(F.col("call").alias("request_id"), _argument("keyword").alias("keyword")))
    met = found.join(rows.select("doc_id", "title", "url", "ext"), "doc_id").withColumn("rank", F.col("position"))
    line = F.concat(F.lit("- ["), F.coalesce("title", F.lit("")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")（"), F.coalesce("ext", F.lit("")), F.lit("）"))
    texts = render._joined(met, "request_id", line, "\n").select(F.col("request_id").alias("call"), F.concat(F.lit(FORMS_HEAD), "text").alias("text"))
    return _said(texts, calls, F.lit(NO_FORMS))


def _search(docs: DataFrame, vectors: DataFrame, index, calls: DataFrame, models: Models, k: int = 6) -> DataFrame:
    """Retrieval of all calls' queries, department by department; a call without a query asks its conversation's."""
    asked = calls.select(F.col("call").alias("query_id"), F.coalesce(F.element_at("arguments", F.lit("search_query")), "query").alias("query"), F.lit(None).cast("array<double>").alias("vector"), "dept")
    hits = None
    for dept in [r.dept for r in asked.select("dept").distinct().collect()]:  # departments are few
        own = asked.where(F.col("dept").eqNullSafe(F.lit(dept))).drop("dept")
        found = _retrieved(docs, vectors, index, own, models, k, dept)
        hits = found if hits is None else hits.unionByName(found)
    met = hits.join(docs.select("doc_id", "title", F.coalesce("category", "type").alias("category"), "page", "url", F.col("text").alias("content")), "doc_id").withColumn("rank", F.col("position"))
    texts = retrieval.context_block(met).select(F.col("query_id").alias("call"), F.concat(F.lit(HITS_HEAD), "context").alias("text"))
    return _said(texts, calls, F.lit(NO_HITS))


def _retrieved(docs: DataFrame, vectors: DataFrame | None, index, asked: DataFrame, models: Models, k: int, dept: str | None = None, use_rerank: bool = True) -> DataFrame:
    """(query_id, position, doc_id); without vectors the lexical list stands alone."""
    if vectors is not None:
        return retrieval.retrieve(index, vectors, asked, models, k, use_rerank, dept, bodies=docs).select("query_id", "position", "doc_id")
    found = retrieval.bm25(index, asked, k, among=None if dept is None else F.col("dept") == dept)
    return found.select("query_id", F.col("rank").alias("position"), "doc_id")


def _answered(base, index, calls: DataFrame, names: list[str]) -> DataFrame:
    """(call, content) of all *calls* (call, conv_id, query, dept, name, arguments), one job for each tool that is called."""
    from kelpline.sources import sinks

    models, out = base.models or Offline(), None
    for name in names:
        own = calls.where(F.col("name") == name)
        if name == "get_latest_news":
            said = _news(base.docs, own)
        elif name == "get_schedule":
            said = _schedule(base.docs, own)
        elif name == "get_competition_records":
            said = _records(base.docs, own)
        elif name == "find_forms":
            said = _forms(base.docs, own)
        elif name == "search_regulations_and_general":
            said = _search(base.docs, base.vectors, index, own, models)
        elif name == "record_correction" and base.corrections is not None:
            rows = own.select("dept", F.coalesce(F.element_at("arguments", F.lit("original_query")), F.lit("未知問題")).alias("topic"), _argument("correction_info").alias("text"))
            sinks.record_corrections(rows, rows["text"] != "", base.corrections)
            said = own.select("call", F.when(_argument("correction_info") != "", F.lit(RECORDED)).otherwise(F.lit(NOT_RECORDED)).alias("content"))
        else:
            said = own.select("call", F.lit(NOT_RECORDED if name == "record_correction" else UNKNOWN_TOOL).alias("content"))
        out = said if out is None else out.unionByName(said)
    return out


def _fallback(base, index, failed: DataFrame) -> DataFrame:
    """(conv_id, answer) of conversations whose model failed."""
    asked = failed.select(F.col("conv_id").alias("query_id"), "query", F.lit(None).cast("array<double>").alias("vector"))
    found = _retrieved(base.docs, base.vectors, index, asked, base.models or Offline(), 5, use_rerank=False)
    met = found.join(base.docs.select("doc_id", "title", "url", "category", "type", "text"), "doc_id").withColumn("rank", F.col("position"))
    lists = render.fallback_list(met, "query_id").withColumnRenamed("query_id", "conv_id")
    return failed.join(lists, "conv_id", "left").select("conv_id", fallback_answer(F.col("text")).alias("answer"))


def run(base, agent: Agent, conversations: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(conv_id, query, answer, rounds, tools, messages, failed) of *conversations* (conv_id, query, dept or null).

    *base* is a ``plans.tools.Knowledge``: documents (with dept, type, category, title, url, ext, date, page, source, text),
    their vectors, and where corrections go. ``tools`` are the tools called, in order. Runs at once.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark)
    scratch.drop_at_exit()
    index = retrieval.build_index(base.docs.select("doc_id", "dept", "text"), keep=["dept"])
    first = conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.min(F.struct("query", "dept")).alias("c"))
    open_ = scratch.cut(first.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("c.query", F.lit("")).alias("query"), "c.dept", F.array().cast(ArrayType(MESSAGE)).alias("messages"), F.array().cast("array<string>").alias("tools")))
    closed = None
    for number in range(rounds):
        last = number == rounds - 1
        replies = agent.reply(open_.withColumn("round", F.lit(number)), not last).select("conv_id", "content", F.col("calls").cast(CALL).alias("calls"), "failed")
        met = scratch.cut(open_.join(replies, "conv_id", "left"))  # the model is asked once
        failed = F.coalesce("failed", F.lit(True))
        going = ~failed & (F.coalesce(F.size("calls"), F.lit(0)) > 0) & F.lit(not last)
        done = met.where(~failed & ~going).select("conv_id", "query", F.coalesce("content", F.lit("")).alias("answer"), F.lit(number + 1).alias("rounds"), "tools", "messages", F.lit(False).alias("failed"))
        broken = met.where(failed)
        if not broken.isEmpty():
            told = _fallback(base, index, broken)
            done = done.unionByName(broken.join(told, "conv_id").select("conv_id", "query", "answer", F.lit(number + 1).alias("rounds"), "tools", "messages", F.lit(True).alias("failed")))
        done = scratch.cut(done)
        closed = done if closed is None else closed.unionByName(done)
        more = met.where(going)
        if last or more.isEmpty():
            break
        each = more.select("conv_id", "query", "dept", F.posexplode("calls").alias("place", "c"))
        arguments = F.coalesce(F.from_json("c.arguments", "map<string,string>"), F.create_map().cast("map<string,string>"))
        number_of = F.coalesce(F.nullif("c.id", F.lit("")), F.concat(F.lit(f"call_{number}_"), F.col("place").cast("string")))
        calls = scratch.cut(each.select("conv_id", "query", "dept", "place", number_of.alias("call_id"), F.col("c.name").alias("name"), arguments.alias("arguments"), F.monotonically_increasing_id().alias("call")))
        names = [r.name for r in calls.select("name").distinct().limit(100).collect()]
        said = scratch.cut(_answered(base, index, calls, [n for n in names if n in TOOLS]).unionByName(_unknown(calls)) if any(n in TOOLS for n in names) else _unknown(calls))
        rows = calls.join(said, "call").select("conv_id", F.struct("place", "name", "call_id", "content").alias("r"))
        results = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("results"))  # a round's calls
        message = lambda role, name, call, content: F.struct(F.lit(role).alias("role"), name.cast("string").alias("name"), call.cast("string").alias("call_id"), content.alias("content"))
        none = F.lit(None)
        asked = F.array(message("assistant", none, none, F.nullif("content", F.lit(""))))
        told = F.transform("results", lambda r: message("tool", r["name"], r["call_id"], r["content"]))
        grown = more.join(results, "conv_id")
        open_ = scratch.cut(grown.select("conv_id", "query", "dept", F.concat("messages", asked, told).alias("messages"), F.concat("tools", F.transform("results", lambda r: r["name"])).alias("tools")))
    return closed


TOOLS = ("get_latest_news", "get_schedule", "get_competition_records", "search_regulations_and_general", "record_correction", "find_forms")


def _unknown(calls: DataFrame) -> DataFrame:
    return calls.where(~F.coalesce(F.col("name").isin(*TOOLS), F.lit(False))).select("call", F.lit(UNKNOWN_TOOL).alias("content"))
