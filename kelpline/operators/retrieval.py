"""Lexical and vector retrieval, rank fusion and reranking over DataFrames.

Rankings carry a total order: ties go to the smaller document id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions import text as tx
from kelpline.operators import inverted
from kelpline.operators.inverted import Inverted
from kelpline.operators.neighbours import nearest
from kelpline.session import Scratch, cut

RANK_BASE = 60


def bags(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *keep, tokens): one row per document, its tokens in order."""
    return docs.select(F.col(doc).cast("long").alias("doc_id"), *keep, tx.index_tokens(F.col(text)).alias("tokens"))


def build_index(docs: DataFrame, **options) -> Inverted:
    """The inverted index of *docs*, kept in the shared folder until the application ends."""
    scratch = Scratch(docs.sparkSession)
    scratch.drop_at_exit()
    return inverted.build(docs, lambda _, df, by: scratch.cut(df, by, inverted.WRITTEN), **options)


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl): one row per document and distinct term."""
    rows = bags(docs, doc, text).select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return rows.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(
    docs: DataFrame | Inverted, queries: DataFrame, k: int = 10, symmetric: bool = True, among: Column | None = None,
    doc: str = "doc_id", text: str = "text", query: str = "query_id", words: str = "query",
) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query.

    ``symmetric`` tokenises queries as documents; otherwise they keep case and whole CJK runs. ``among``, an
    expression of *docs* (of an index: of its kept columns), limits what is ranked but not the corpus statistics.
    Documents without any query term score zero and fill the list by id. Documents without an id take no part.
    Runs at once: documents are indexed first, and what is read of an index depends on the first scores.
    """
    if not isinstance(docs, Inverted):
        allowed = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
        docs, among = build_index(docs.withColumn("_allowed", allowed), doc=doc, text=text, keep=["_allowed"]), F.col("_allowed")
    return inverted.search(docs, queries, k, symmetric, among, query, words)


def _top(rows: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def filter_after(found: DataFrame, keep: Column, k: int) -> DataFrame:
    """Re-ranks what is left of a wider ranking after a filter: up to k rows, fewer if the filter bites."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.where(keep).withColumn("rank", place).where(F.col("rank") <= k)


def fuse_best_rank(lists: Sequence[DataFrame], k: int) -> DataFrame:
    """(query_id, position, doc_id, best_rank, fused): each document's best rank over all lists, 1/(60 + rank).

    Equal ranks keep the order of first sight: lists in the given order, then rank.
    """
    rows = None
    for number, ranked in enumerate(lists):
        own = ranked.select("query_id", "doc_id", "rank", F.lit(number).alias("list_no"))
        rows = own if rows is None else rows.unionByName(own)
    return _fuse(rows, k)


def _fuse(rows: DataFrame, k: int) -> DataFrame:
    best = rows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best_rank"), F.min(F.struct("list_no", "rank")).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("best_rank", "first", "doc_id"))
    fused = best.withColumn("position", place).where(F.col("position") <= k)
    return fused.select("query_id", "position", "doc_id", "best_rank", F.round(1 / (RANK_BASE + F.col("best_rank")), 8).alias("fused"))


def query_variants(query: Column, rewrites: Column, passage: Column, most: int = 5) -> Column:
    """The query, its rewrites and a hypothetical passage, each once, in that order, cut to *most*."""
    return F.slice(F.array_distinct(F.concat(F.array(query), rewrites, F.array(passage))), 1, most)


def variant_vectors(variants: DataFrame, vectors: DataFrame, k: int, most: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """(query_id, doc_id, rank, list_no): the nearest of each of *variants* (query_id, number below *most*, vector or null)."""
    # One search for all variants: a list's id is its query's times *most*, plus the variant's number.
    asked = variants.where(F.col("vector").isNotNull()).select((F.col("query_id") * most + F.col("number")).alias("query_id"), "vector", *keys)
    number = F.pmod(F.col("query_id"), F.lit(most)).cast("int")
    return nearest(asked, vectors, k, keys).select(F.expr(f"(query_id - pmod(query_id, {most})) div {most}").alias("query_id"), "doc_id", "rank", number.alias("list_no"))


def retrieve(docs: DataFrame | Inverted, vectors: DataFrame, queries: DataFrame, models, k: int = 8, use_rerank: bool = True, dept: str | None = None, most: int = 5, window: int = 10, bodies: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(query_id, position, doc_id, rerank_score): the whole retrieval of *queries* (query_id, query, vector or null).

    Each query becomes up to *most* variants: itself, its rewrites, a hypothetical passage. The k nearest of each
    variant and the k best by BM25 for the words of all are fused by their best rank and cut to *depth* (3k unless
    told; the evaluation's forms take 2k and k); the first *window*
    of those are ordered by the models' relevance (null scores, or ``use_rerank`` off: the fused order stays) and
    cut to k. With *dept*, an exact filter: both lists hold documents of that department only. Without any vectors
    there is no index and nothing is found. *bodies* (doc_id, text, and dept for a filter) are needed beside an
    index; *vectors* are (doc_id, vector).
    """
    bodies = docs if bodies is None else bodies
    texts = query_variants(F.col("query"), models.rewrites(F.col("query")), models.passage(F.col("query")), most)
    variants = queries.select("query_id", F.col("vector").alias("own"), F.posexplode(texts).alias("number", "words"))
    variants = variants.select("query_id", "number", "words", models.embed(F.col("words"), F.col("own")).alias("vector"))
    if vectors.isEmpty():
        queries = queries.limit(0)
    corpus = vectors if dept is None else vectors.join(bodies.where(F.col("dept") == dept).select("doc_id"), "doc_id", "left_semi")
    spoken = variants.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", "words"))).alias("said"))  # *most* at most
    spoken = spoken.select("query_id", F.array_join(F.transform("said", lambda v: v["words"]), " ").alias("query")).join(queries.select("query_id"), "query_id", "left_semi")
    lexical = bm25(docs, spoken, k, among=None if dept is None else F.col("dept") == dept)
    near = variant_vectors(variants, corpus, k, most)
    fused = _fuse(near.unionByName(lexical.select("query_id", "doc_id", "rank", F.lit(most).alias("list_no"))), 3 * k if depth is None else depth).withColumnRenamed("position", "rank")
    if not use_rerank:
        return fused.where(F.col("rank") <= k).select("query_id", F.col("rank").alias("position"), "doc_id", F.lit(None).cast("double").alias("rerank_score"))
    fused = cut(fused)
    texts = bodies.select("doc_id", "text").join(fused.select("doc_id"), "doc_id", "left_semi")  # of the others nothing is shuffled
    met = fused.join(texts, "doc_id", "left").join(queries.select("query_id", "query"), "query_id")
    scored = met.withColumn("_score", models.relevance(F.col("query"), F.col("text")))
    failed = F.max(F.col("_score").isNull()).over(Window.partitionBy("query_id"))  # a scorer that failed for one failed for its query
    scored = scored.withColumn("_failed", failed).where(F.col("_failed") | (F.col("rank") <= window))
    scored = scored.withColumn("rerank_score", F.when(~F.col("_failed"), F.round("_score", 6)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank"))
    return scored.withColumn("position", place).where(F.col("position") <= k).select("query_id", "position", "doc_id", "rerank_score")


def overlap_score(query: Column, body: Column, snippet: int | None = 300) -> Column:
    """The offline stand-in for a reranking model: share of the query's distinct tokens found in the snippet, or in all of *body*."""
    asked = F.array_distinct(tx.index_tokens(query))
    found = F.array_intersect(asked, tx.index_tokens(body if snippet is None else F.substring(body, 1, snippet)))
    return F.coalesce(F.try_divide(F.size(found).cast("double"), F.size(asked)), F.lit(0.0))


def rerank(candidates: DataFrame, score: Column, k: int, window: int = 10) -> DataFrame:
    """Orders the first *window* candidates (query_id, rank, doc_id) by *score*, ties by rank; the rest are dropped."""
    first = candidates.where(F.col("rank") <= window).withColumn("rerank_score", F.round(score, 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank"))
    return first.withColumn("position", place).where(F.col("position") <= k)


def rerank_scores(candidates: DataFrame, scores: Column, k: int, window: int = 10) -> DataFrame:
    """Reranking by an array of scores per query, zipped to the candidates: a shorter array cuts the tail.

    A null array stands for a scorer that failed: the fused order stays, whole.
    """
    failed = scores.isNull()
    zipped = candidates.where(failed | ((F.col("rank") <= window) & (F.col("rank") <= F.size(scores))))
    own = F.when(~failed, F.get(scores, F.col("rank") - 1))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("own_score"), "rank"))
    return zipped.withColumn("own_score", own).withColumn("position", place).where(F.col("position") <= k)


def context_block(hits: DataFrame, most: int = 1200) -> DataFrame:
    """(query_id, context): the hits' blocks (title, category, page, url, content) joined in rank order."""
    head = lambda name, c: F.concat(F.lit(f"【{name}】"), F.coalesce(F.col(c), F.lit("")), F.lit("\n"))
    block = F.concat(head("文件名稱", "title"), head("文件類型", "category"), head("頁碼", "page"), head("來源網址", "url"), F.lit("【文件內容】\n"), F.substring(F.coalesce("content", F.lit("")), 1, most))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))  # a few hits per query
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n---\n\n").alias("context"))
