"""Queries over the driver's tables, one or more for each family of operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import text as tx
from kelpline.operators import bulk, chunking, evaluation, feedback, lookup, metadata, retrieval, state
from kelpline.operators import models as models_
from kelpline.operators.models import Models, Offline
from kelpline.plans import oracle, table_functions
from kelpline.session import Scratch, table
from kelpline.sources import corpus, markdown, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the roles of the knowledge base: title, date, department."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("dept"), "lang",
        F.substring("text", 1, 30).alias("title"), F.lpad(F.col("n_chars").cast("string"), 8, "0").alias("date"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
    )


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_indexes: dict[tuple[str, str], retrieval.Inverted] = {}


def _index(spark: SparkSession, sf_dir: str) -> retrieval.Inverted:
    """The lexical index of the documents, built once for the same contents and stored until the application ends."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dept"), "text")
    told = docs.select("dept", F.concat_ws(" ", F.col("doc_id").cast("string"), "text").alias("text"))
    mark = spark.sparkContext.applicationId, metadata.fingerprint(told, "dept").first().fingerprint
    if mark not in _indexes:
        _indexes[mark] = retrieval.build_index(docs, keep=["dept"])
    return _indexes[mark]


@query("bm25_topk", oracle.bm25("SELECT query_id, rank, doc_id, score FROM top"))
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(_index(spark, sf_dir), _asked(spark, sf_dir), 10)


@query("bm25_compat_query_tokens", oracle.bm25("SELECT query_id, rank, doc_id, score FROM top", lower=False))
def bm25_compat(spark, sf_dir):
    return retrieval.bm25(_index(spark, sf_dir), _asked(spark, sf_dir), 10, symmetric=False)


@query("bm25_by_department", oracle.bm25("SELECT query_id, rank, doc_id, score FROM top", among="dept = 'src1'"))
def bm25_by_department(spark, sf_dir):
    return retrieval.bm25(_index(spark, sf_dir), _asked(spark, sf_dir), 10, among=F.col("dept") == "src1")


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _vector_queries(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).where(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "query_id")


@query("knn_l2_topk", oracle.KNN.format(k=5, join="", keep=""))
def knn_l2_topk(spark, sf_dir):
    return retrieval.nearest(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir), 5)


@query("knn_postfilter", oracle.KNN_AFTER)
def knn_postfilter(spark, sf_dir):
    """The compatible form: 3k neighbours, then the filter by the query's department, then ranks anew. Vectors without a
    document have no department, so the filter drops them."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dept"))
    found = retrieval.nearest(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir), 24)
    found = found.join(own.withColumnRenamed("dept", "doc_dept"), "doc_id").join(own.select(F.col("doc_id").alias("query_id"), F.col("dept").alias("query_dept")), "query_id")
    return retrieval.filter_after(found, F.col("doc_dept") == F.col("query_dept"), 8).select("query_id", "rank", "doc_id", "distance")


@query("knn_filtered_exact", oracle.KNN_EXACT)
def knn_filtered_exact(spark, sf_dir):
    """The exact form: the nearest of the query's own department. Vectors without a document belong to none."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dept"))
    corpus = _vectors(spark, sf_dir).join(own, "doc_id")
    asked = corpus.where(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "query_id")
    return retrieval.nearest(asked, corpus, 8, keys=["dept"])


@query("hybrid_minrank", oracle.HYBRID)
def hybrid_minrank(spark, sf_dir):
    """BM25 over all documents and the nearest of all vectors, fused by union: neither list limits the other."""
    vectors, asked = _vectors(spark, sf_dir), _asked(spark, sf_dir)
    by_vector = vectors.join(asked.select("query_id"), F.col("doc_id") == F.col("query_id")).select("query_id", "vector")
    lists = [retrieval.nearest(by_vector, vectors, 24), retrieval.bm25(_index(spark, sf_dir), asked, 24)]
    return retrieval.fuse_best_rank(lists, 24)


@query("rerank_overlap", oracle.RERANK)
def rerank_overlap(spark, sf_dir):
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    met = retrieval.bm25(_index(spark, sf_dir), asked, 10).join(docs.select("doc_id", "text"), "doc_id").join(asked, "query_id")
    return retrieval.rerank(met, Offline().relevance(F.col("query"), F.col("text")), 8).select("query_id", "position", "doc_id", "rerank_score")


def _with_vectors(spark, sf_dir) -> DataFrame:
    own = _vectors(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "vector")
    return _asked(spark, sf_dir).join(own, "query_id", "left")


@query("retrieve_and_rerank", oracle.RETRIEVE)
def retrieve_and_rerank(spark, sf_dir, models: Models | None = None):
    """The whole retrieval: variants, the nearest of each, BM25 of all their words, fusion, reranking, final cut."""
    return retrieval.retrieve(_index(spark, sf_dir), _vectors(spark, sf_dir), _with_vectors(spark, sf_dir), models or Offline(), bodies=_docs(spark, sf_dir))


@query("retrieve_in_department", oracle.RETRIEVE_IN)
def retrieve_in_department(spark, sf_dir):
    """The same within one department and without reranking."""
    return retrieval.retrieve(_index(spark, sf_dir), _vectors(spark, sf_dir), _with_vectors(spark, sf_dir), Offline(), use_rerank=False, dept="src1", bodies=_docs(spark, sf_dir)).drop("rerank_score")


@query("retrieve_at_evaluation_depth", oracle.RETRIEVE_EVAL)
def retrieve_at_evaluation_depth(spark, sf_dir):
    """The form of the evaluation that fuses as many as it returns, without reranking."""
    return retrieval.retrieve(_index(spark, sf_dir), _vectors(spark, sf_dir), _with_vectors(spark, sf_dir), Offline(), use_rerank=False, bodies=_docs(spark, sf_dir), k=12, depth=9).drop("rerank_score")


@query("context_snippets", oracle.CONTEXT)
def context_snippets(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    hits = retrieval.bm25(_index(spark, sf_dir), _asked(spark, sf_dir), 3).join(docs, "doc_id")
    named = hits.select("query_id", "rank", F.col("url").alias("title"), F.col("lang").alias("category"), F.col("dept").alias("page"), F.lit("").alias("url"), F.col("text").alias("content"))
    context = retrieval.context_block(named)
    return context.select("query_id", F.length("context").alias("chars"), F.md5(F.encode("context", "utf-8")).alias("digest"))


@query("source_attribution", oracle.ATTRIBUTION)
def source_attribution(spark, sf_dir):
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    hits = retrieval.bm25(_index(spark, sf_dir), asked, 3).join(docs.select("doc_id", "title", "url", F.col("dept").alias("type"), F.lit("").alias("page")), "doc_id")
    answers = lookup.list_sources(hits).join(asked.withColumnRenamed("query", "answer"), "query_id")
    found = lookup.attribute_sources(answers)
    return found.select("query_id", F.size("sources").alias("n_sources"), F.array_join(F.transform("sources", lambda s: s["url"]), ",").alias("urls"))


@query("chunk_fixed", oracle.CHUNK_FIXED)
def chunk_fixed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.windows(F.col("text"), 800)).alias("chunk_id", "chunk"))
    return rows.select("doc_id", "chunk_id", F.length("chunk").alias("chars"), F.md5(F.encode("chunk", "utf-8")).alias("digest"))


@query("translate_windows", oracle.TRANSLATED)
def translate_windows(spark, sf_dir):
    """Texts translated by windows, with capitals for a translation that fails for windows beginning with a blank or a vowel."""
    spoken = lambda w: F.when(~w.rlike("^[ aeiouAEIOU]"), F.translate(w, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    rows = table(spark, sf_dir, "documents").select("doc_id", chunking.translated(F.col("text"), spoken, 300).alias("t"))
    return rows.select("doc_id", F.length("t").alias("chars"), F.md5(F.encode("t", "utf-8")).alias("digest"))


@query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    """Null texts have no chunks."""
    return chunking.chunks(table(spark, sf_dir, "documents"))


@query("index_token_counts", oracle.TOKEN_COUNTS)
def index_token_counts(spark, sf_dir):
    rows = retrieval.bags(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.size("tokens").alias("tokens"), F.size(F.array_distinct("tokens")).alias("terms"))


@query("index_postings", oracle.POSTINGS)
def index_postings(spark, sf_dir):
    return retrieval.postings(table(spark, sf_dir, "documents"))


@query("metadata_left_join", oracle.LEFT_JOIN)
def metadata_left_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return metadata.with_metadata(docs, table(spark, sf_dir, "labels"), "doc_id", {"quality": -1, "toxic": -1})


@query("metadata_unmatched", oracle.UNMATCHED)
def metadata_unmatched(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return metadata.unmatched(docs, table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("unmatched"))


@query("corpus_fingerprint", oracle.FINGERPRINT)
def corpus_fingerprint(spark, sf_dir):
    return metadata.fingerprint(table(spark, sf_dir, "documents"), "source")


@query("dense_ids", oracle.DENSE)
def dense_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("url", "page_id")
    return metadata.dense_ids(rows, ["url", "page_id"]).select("page_id", "doc_id")


@query("strip_markup", oracle.STRIP)
def strip_markup(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", tx.clean_markup(F.col("html")).alias("text"))
    return rows.select("page_id", F.length("text").alias("chars"), F.md5(F.encode("text", "utf-8")).alias("digest"))


@query("title_keys", oracle.TITLE_KEYS)
def title_keys(spark, sf_dir):
    url = F.element_at(F.split("url", "/"), -1)
    return table(spark, sf_dir, "pages").select("page_id", tx.title_key(url).alias("title_norm"), tx.citation_key(url).alias("cited"), tx.has_cjk(F.col("html")).alias("cjk"))


@query("latest_per_title", oracle.LATEST)
def latest_per_title(spark, sf_dir):
    return lookup.latest_news(_docs(spark, sf_dir), 6).select("doc_id", "title", "date")


@query("keyword_rank", oracle.KEYWORD)
def keyword_rank(spark, sf_dir):
    return lookup.keyword_news(_docs(spark, sf_dir), "The token, license tion the", 6).select("doc_id", "score", "date")


@query("weighted_match", oracle.FORMS)
def weighted_match(spark, sf_dir):
    return lookup.find_forms(_docs(spark, sf_dir), "the ", 20).select("doc_id", "score")


@query("filter_strict", oracle.RECORDS_STRICT)
def filter_strict(spark, sf_dir):
    return lookup.find_records(_docs(spark, sf_dir), keyword="License/tion", year="15", name="the").drop("text")


@query("filter_with_fallback", oracle.RECORDS_RELAXED)
def filter_with_fallback(spark, sf_dir):
    return lookup.find_records(_docs(spark, sf_dir), keyword="nosuchword", name="License").drop("text")


def _requests(spark, sf_dir) -> DataFrame:
    """Requests made of all benchmark passages: the first words of each."""
    word = lambda i: F.coalesce(F.get(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lit(i)), F.lit(""))
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        i.alias("request_id"), F.substring("text", 1, 40).alias("query"), F.when(i % 3 == 0, F.lit("src1")).alias("dept"), F.when(i % 5 != 0, F.concat(F.lit(" "), word(0), F.lit(" "), word(1))).alias("words"),
        F.when(i % 7 == 0, F.lit("nosuchword")).when(i % 7 != 1, F.concat(word(0), F.lit("/"), word(2))).alias("keyword"), F.when(i % 4 == 0, "15").when(i % 4 == 1, "x1").otherwise("").alias("year"), F.when(i % 2 == 0, word(1)).alias("name"),
    )


@query("bulk_keyword_news", oracle.BULK_NEWS)
def bulk_keyword_news(spark, sf_dir):
    return bulk.keyword_news(_docs(spark, sf_dir), _requests(spark, sf_dir), 6)


@query("bulk_find_forms", oracle.BULK_FORMS)
def bulk_find_forms(spark, sf_dir):
    return bulk.find_forms(_docs(spark, sf_dir).withColumn("url", F.col("dept")), _requests(spark, sf_dir).select("request_id", F.col("words").alias("keyword")), 20)


@query("lateral_find_forms", f"SELECT request_id, doc_id, score FROM ({oracle.BULK_FORMS})")
def lateral_find_forms(spark, sf_dir):
    """The same through a table function in SQL, called for each request."""
    table_functions.register(spark, _docs(spark, sf_dir).withColumns({"url": F.col("dept"), "category": F.lit("表單"), "type": F.lit("news")}), "q_")
    _requests(spark, sf_dir).createOrReplaceTempView("q_requests")
    return spark.sql("SELECT request_id, f.doc_id, f.score FROM q_requests, LATERAL q_find_forms(words) f")


@query("bulk_find_records", oracle.BULK_RECORDS)
def bulk_find_records(spark, sf_dir):
    return bulk.find_records(_docs(spark, sf_dir), _requests(spark, sf_dir))


@query("rate_limit_admission", oracle.ADMISSION)
def rate_limit_admission(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id")
    return state.admit(rows, "user_id", "micros", "event_id", 2, 6 * 3600 * 1_000_000).select("event_id", "user_id", "admitted")


@query("history_last8", oracle.HISTORY)
def history_last8(spark, sf_dir):
    return state.history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "back")


@query("last_user_turn", oracle.LAST_USER)
def last_user_turn(spark, sf_dir):
    return state.last_user_turn(table(spark, sf_dir, "conversations"))


def _answers(spark, sf_dir) -> DataFrame:
    """Views and purchases as answers: several may share a message id."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase"))
    session = F.when(F.col("user_id") % 10 == 0, F.lit("")).otherwise(F.col("user_id").cast("string"))
    return rows.select(F.concat(F.lit("m"), (F.col("event_id") % 5000).cast("string")).alias("message_id"), F.col("event_id").alias("seq"), F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("dept"), session.alias("session_id"), F.col("value").alias("latency_s"), "event_type")


def _feedback(spark, sf_dir) -> DataFrame:
    """Clicks are up, errors down, sign-ups neither."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error", "signup"))
    rating = F.when(F.col("event_type") == "click", "up").when(F.col("event_type") == "error", "down").otherwise("maybe")
    return rows.select(F.concat(F.lit("m"), (F.col("event_id") * 7 % 6000).cast("string")).alias("message_id"), F.col("event_id").alias("seq"), rating.alias("rating"), F.col("value").alias("weight"))


def _latest_feedback(spark, sf_dir) -> DataFrame:
    return feedback.latest(_feedback(spark, sf_dir), "message_id", "seq")


def _latest_answers(spark, sf_dir) -> DataFrame:
    return feedback.latest(_answers(spark, sf_dir), "message_id", "seq").drop("first_seen")


@query("feedback_latest", oracle.FEEDBACK + "SELECT message_id, seq, rating, first_seen FROM feedback")
def feedback_latest(spark, sf_dir):
    return _latest_feedback(spark, sf_dir).select("message_id", "seq", "rating", "first_seen")


@query("feedback_rates", oracle.FEEDBACK_RATES)
def feedback_rates(spark, sf_dir):
    return feedback.rates(_latest_feedback(spark, sf_dir))


@query("feedback_rate_by_dept", oracle.FEEDBACK_BY_DEPT)
def feedback_rate_by_dept(spark, sf_dir):
    return feedback.rates_by(_latest_feedback(spark, sf_dir), _latest_answers(spark, sf_dir), "dept")


@query("feedback_orphans", oracle.FEEDBACK + "SELECT f.message_id, f.rating FROM feedback f ANTI JOIN answers a USING (message_id)")
def feedback_orphans(spark, sf_dir):
    return feedback.orphans(_latest_feedback(spark, sf_dir), _latest_answers(spark, sf_dir)).select("message_id", "rating")


@query("negative_cases", oracle.NEGATIVE)
def negative_cases(spark, sf_dir):
    answers = _latest_answers(spark, sf_dir).select("message_id", "dept")
    return feedback.negative_cases(_latest_feedback(spark, sf_dir).drop("seq"), answers).select("message_id", "first_seen", F.coalesce("dept", F.lit("?")).alias("dept"))


@query("usage_sessions", oracle.USAGE)
def usage_sessions(spark, sf_dir):
    return feedback.usage(_latest_answers(spark, sf_dir), "dept")


@query("latency_nearest_rank", oracle.NEAREST_RANK)
def latency_nearest_rank(spark, sf_dir):
    return feedback.nearest_rank(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("latency_nearest_rank_all", oracle.NEAREST_RANK_ALL)
def latency_nearest_rank_all(spark, sf_dir):
    """One group of all rows."""
    return feedback.nearest_rank(table(spark, sf_dir, "events"), "value", [])


@query("latency_mean_median", "SELECT round_even(avg(value), 1) AS mean_s, round_even(median(value), 1) AS median_s FROM events")
def latency_mean_median(spark, sf_dir):
    return evaluation.latency(table(spark, sf_dir, "events").withColumnRenamed("value", "latency_s"))


@query("verdict_rollup", oracle.VERDICTS)
def verdict_rollup(spark, sf_dir):
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    verdict = F.when(good & ~toxic, "CORRECT").when(good, "PARTIAL").when(~toxic, "WRONG").otherwise("JUDGE_ERROR")
    hit = F.when(F.col("lang") != "es", F.col("lang") == "en")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dept"), "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluation.verdict_rollup(rows.select("dept", verdict.alias("verdict"), hit.alias("tool_hit"))).withColumn("overall", F.col("overall").cast("int"))


SIGNATURES = {"tool_en": ("the ", "and", "ing"), "tool_fr": ("les", "aux", "ion"), "tool_de": ("ung", "lich", "der ")}


@query("tool_infer_argmax", oracle.TOOLS)
def tool_infer_argmax(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluation.infer_tool(F.col("text"), SIGNATURES, "tool_search").alias("tool"))


@query("topic_adherence", oracle.ADHERENCE)
def topic_adherence(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select(F.col("conv_id").alias("id"), "turn", F.col("text").alias("answer"))
    meta = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 0).alias("topic_adherent"))
    return evaluation.adherence(rows, meta, ["Lich ", "THE EA"]).groupBy("id").agg(F.count_if("refused").alias("refused"), F.round(evaluation.metric_mean(F.col("adherence")), 6).alias("adherence"))


@query("roc_year_rewrite", oracle.YEARS)
def roc_year_rewrite(spark, sf_dir):
    """Years made of all events' ids, in the four forms in which queries name them."""
    n = (F.col("event_id") % 3000).cast("string")
    form = F.element_at(F.array(F.concat(n, F.lit("年")), F.concat(n, F.lit("學年度")), F.concat(F.lit("民國 "), n, F.lit(" 年")), F.concat(F.lit("no "), n)), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(form.alias("query")).distinct()
    return rows.select("query", tx.rewrite_years(F.col("query"), compat=True).alias("compat"), tx.rewrite_years(F.col("query")).alias("strict"))


def _knowledge_files(spark, sf_dir) -> dict[str, DataFrame]:
    """Markdown files made of each document's id and the digest of its text: the tables hold no Markdown."""
    i, digest = F.col("doc_id").cast("string"), F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", F.lpad(i, 12, "0").alias("path"), digest.alias("d"), i.alias("i"))

    def files(pattern: str) -> DataFrame:
        parts = [F.lit(p) if n % 2 == 0 else F.col({"i": "i", "d": "d", "k": "k", "day": "day"}[p]) for n, p in enumerate(pattern.split("`"))]
        made = docs.withColumns({"k": (F.col("doc_id") % 7).cast("string"), "day": (F.col("doc_id") % 28 + 1).cast("string")})
        return made.select("path", F.concat(*parts).alias("md"))

    return {
        "main": files(
            "before\n# 最新消息\n## 2024 / 1 / `day`\n**[N`i`](http://u/`i`)**\nbody `d`\n---\nplain `d`\n# 常見問題\nintro\n### Q`i`?\nA `d`\n# P`k`\npage `d`\n# P`k`\ntwice"
            "\n# 競賽成績\n| 學年度 | 賽事名稱 | x | y | z |\n|---|---|---|---|---|\n| `i` | G | R | 1 | Ann |\n| too | few |"
        ),
        "regulations": files("top\n---\n## 📄 F`i`.doc\n文件類型：表單\n來源網址：https://u/`i`\n原始格式：doc\n\n### Page 1\nform `d`\n---\n## 📄 R`i`\n文件類型：法規\n"),
        "corrections": files("# head\n\n## 修正紀錄：x\n- **所屬處室**：GE（x）\nright `d`\n\nother\n\n## 修正紀錄：y\nno dept `i`"),
        "crawled": files("# 最新消息\n（無法擷取內文）\n# 法令規章\n## A`i`.pdf\n### Page 1\nrule `d`\n## empty\n"),
        "meta": docs.where(F.col("doc_id") % 2 == 0).select(F.concat(F.lit("A"), "i").alias("title_norm"), F.concat(F.lit("http://m/"), "i").alias("url"), F.lit("表單").alias("category"), F.lit("form").alias("type"), F.lit("d").alias("date")),
    }


@query("corpus_build", oracle.CORPUS)
def corpus_build(spark, sf_dir):
    """The typed corpus of all kinds of sources, one file of each kind per document."""
    f = _knowledge_files(spark, sf_dir)
    built = corpus.build(spark, f["main"], f["regulations"], f["corrections"], {"ge": f["crawled"]}, meta={"ge": f["meta"]})
    return built.select("doc_id", "dept", "type", "page", "title", F.coalesce("date", F.lit("")).alias("date"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("category", F.lit("")).alias("category"), "text")


@query("regulation_lines", oracle.LINES)
def regulation_lines(spark, sf_dir):
    return markdown.regulation_lines(_knowledge_files(spark, sf_dir)["crawled"]).select("path", "title", "page", "text")


@query("events_jsonl", oracle.JSONL)
def events_jsonl(spark, sf_dir):
    """All events written as JSON lines, some broken, blank or with fields of other types, and read again: kind and place of each
    line, its latency and how many reasons it has."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "answer").otherwise("feedback").alias("event"))
    sent = rows.select("event_id", F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), "event")
    line = F.to_json(F.struct("event", "message_id"))
    more = lambda fields: F.concat(F.expr("left(line, length(line) - 1)"), F.lit(f", {fields}}}"))
    sent = sent.withColumn("line", line)
    line = F.when(F.col("event_id") % 10 == 5, more('"reasons": "other", "latency_s": true')).when(F.col("event_id") % 10 == 7, more('"reasons": ["other", "outdated"]'))
    line = line.when(F.col("event_id") % 10 == 6, more('"latency_s": "1.5", "sources": 3')).when(F.col("event_id") % 10 == 8, more('"latency_s": 2.25, "tools": {}')).otherwise(F.col("line"))
    line = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken "), "message_id")).when(F.col("event_id") % 10 == 4, F.lit(" ")).otherwise(line)
    scratch = Scratch(spark)
    scratch.drop_at_exit()
    place = f"{scratch.folder}/log"
    sent.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(place)
    answers, voted, corrupt = tables.events(spark, place)
    none = F.lit(None)
    told = lambda rows, kind, what, latency, reasons: rows.select("seq", F.lit(kind).alias("kind"), F.col(what).alias("what"), latency.cast("double").alias("latency_s"), reasons.cast("int").alias("n_reasons"))
    both = told(answers, "answer", "message_id", F.col("latency_s"), none).unionByName(told(voted, "feedback", "message_id", none, F.when(F.col("reasons").isNotNull(), F.size("reasons"))))
    return both.unionByName(told(corrupt, "corrupt", "value", none, none))


@query("corrections_recorded", oracle.CORRECTIONS)
def corrections_recorded(spark, sf_dir):
    """What is recorded as a correction for each labelled document is found by the parser: department and record."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "GE").otherwise("unknown").alias("dept"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("topic"), F.lit("a\n\n \nb").alias("text"), "quality")
    scratch = Scratch(spark)
    scratch.drop_at_exit()
    place = f"{scratch.folder}/corrections"
    sinks.record_corrections(rows, F.col("quality") == 1, place, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    found = markdown.corrections(markdown.read_files(spark, [place]))
    return found.select("dept", F.regexp_extract("text", "主題\\*\\*：(t[0-9]+)", 1).alias("topic"), F.length("text").alias("chars"))


@query("feedback_validated", oracle.VALIDATED)
def feedback_validated(spark, sf_dir):
    """Validation of raw feedback made of all events: case, blanks, unknown and repeated reasons, long comments."""
    e = F.col("event_id")
    rating = F.element_at(F.array(F.lit(" UP "), F.lit("down"), F.lit("maybe"), F.lit(None)), (e % 4 + 1).cast("int"))
    reasons = F.array(F.lit("other"), F.col("event_type"), F.lit("other"), F.lit("outdated"))
    rows = table(spark, sf_dir, "events").select("event_id", rating.alias("rating"), F.when(e % 6 != 5, F.concat(F.lit(" m"), e.cast("string"), F.lit(" "))).alias("message_id"), reasons.alias("reasons"), F.repeat(F.lit("c"), (e % 700).cast("int")).alias("comment"))
    return feedback.valid_feedback(rows).select("event_id", "rating", "message_id", F.array_join("reasons", ",").alias("reasons"), F.length("comment").alias("chars"))


@query("judged_completeness", oracle.COMPLETENESS)
def judged_completeness(spark, sf_dir):
    """The rules around a judge, with its reply taken from the events' values."""
    e = F.col("event_id")
    answer = F.when(e % 5 == 0, F.lit("")).when(e % 5 == 1, F.lit("查無資料")).otherwise(F.lit("text"))
    reply = F.when(e % 3 == 0, F.lit("none")).when(e % 3 == 1, F.lit("score 7")).otherwise(F.concat(F.lit("0."), (e % 1000).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", models_.completeness(answer, F.lit("truth"), reply).alias("completeness"))
