import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from kelpline.functions import text
from kelpline.operators import inverted, retrieval
from kelpline.operators.models import Offline
from kelpline.plans import queries

DOCS = [(0, "alpha beta beta"), (1, "beta gamma"), (2, "delta"), (3, "alpha alpha delta Beta"), (4, ""), (5, "gamma beta"), (6, "beta")]


def okapi(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {i: re.findall(r"[a-z]+", t.lower()) for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    floor = eps * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    score = {i: round(sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg)) for w in query), 6) for i, t in toks.items()}
    return sorted(score.items(), key=lambda p: (-p[1], p[0]))


def bm25(spark, query, k=4, **options):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    rows = retrieval.bm25(docs, spark.createDataFrame([(1, query)], "query_id long, query string"), k, **options).orderBy("rank").collect()
    return [(r.doc_id, r.score) for r in rows]


def test_bm25_equals_model(spark):
    for query in ("alpha beta", "beta", "delta delta", "nothing"):
        assert bm25(spark, query) == okapi(DOCS, query.split())[:4]


def test_bm25_query_form_and_filter(spark):
    assert bm25(spark, "ALPHA", symmetric=False) == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]
    assert [d for d, _ in bm25(spark, "alpha", among=F.col("doc_id") > 2)] == [3, 4, 5, 6]


def test_nearest_and_filters(spark):
    vectors = [(i, [float(i), 0.0], "a" if i % 4 == 0 else "b") for i in range(12)]
    corpus = spark.createDataFrame(vectors, "doc_id long, vector array<double>, dept string")
    query = spark.createDataFrame([(100, [2.2, 0.0], "a")], "query_id long, vector array<double>, dept string")
    wide = retrieval.nearest(query, corpus, 3)
    assert [r.doc_id for r in wide.orderBy("rank").collect()] == [2, 3, 1]
    kept = retrieval.filter_after(wide.join(corpus.select("doc_id", "dept"), "doc_id"), F.col("dept") == "a", 1)
    assert kept.count() == 0  # all of the wider list is in other departments
    assert [r.doc_id for r in retrieval.nearest(query, corpus, 2, keys=["dept"]).orderBy("rank").collect()] == [4, 0]


def test_nearest_passes_over_what_is_no_vector(spark):
    vectors = [(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (6, [3.0, 4.0]), (None, [0.0, 0.0])]
    corpus = spark.createDataFrame(vectors, "doc_id long, vector array<double>")
    asked = corpus.where("doc_id < 4").withColumnRenamed("doc_id", "query_id")
    got = [tuple(r) for r in retrieval.nearest(asked, corpus, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, 0.0), (1, 2, 6, 25.0), (3, 1, 3, 0.0)]
    assert retrieval.nearest(asked, corpus.limit(0), 5).count() == 0


def test_nearest_skips_far_shards(spark):
    rng = random.Random(6)
    centres = [[rng.uniform(-9, 9) for _ in range(6)] for _ in range(8)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centres[i % 8]], "a" if i % 3 else "b") for i in range(400)]
    rows += [(1000 + i, rows[5][1], "a") for i in range(50)] + [(2000, [1.0] * 4, "a"), (2001, [2.0] * 4, "b"), (2002, None, "a"), (2003, [0.0] * 6, None), (7, rows[7][1], "b")]
    corpus = spark.createDataFrame(rows, "doc_id long, vector array<double>, dept string").repartition(3)
    asked = corpus.where("doc_id % 40 = 0 or doc_id in (5, 2001)").withColumnRenamed("doc_id", "query_id")
    for keys, k in (([], 6), (["dept"], 4), ([], 60)):
        read = {}
        found = {}
        for r in retrieval.nearest(asked, corpus, k, keys=keys, shard_rows=25, block=5, read=read).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.doc_id, r.distance))
        for q, x, dept in rows:
            if x is not None and (q % 40 == 0 or q in (5, 2001)) and not (keys and dept is None):
                every = [(round(sum((a - b) ** 2 for a, b in zip(x, y)), 10), i) for i, y, d in rows if y is not None and len(y) == len(x) and (not keys or d == dept)]
                assert found[q] == [(i, round(d, 6)) for d, i in sorted(every)[:k]]
        assert k == 60 or read["compared"] < 0.75 * read["rows"]


def test_bm25_in_blocks_and_from_an_index(spark):
    docs = spark.createDataFrame([(i, t, "a" if i % 2 else "b") for i, t in DOCS], "doc_id long, text string, dept string")
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["alpha beta", "beta", "", None, "delta delta"])], "query_id long, query string")
    index = retrieval.build_index(docs, keep=["dept"], cell_docs=2)
    whole = sorted(map(tuple, retrieval.bm25(docs, asked, 3).collect()))
    assert whole == sorted(map(tuple, retrieval.bm25(index, asked, 3).collect()))
    assert [(d, s) for q, _, d, s in whole if q == 0] == okapi(DOCS, ["alpha", "beta"])[:3] and [s for q, _, _, s in whole if q == 3] == [0.0] * 3
    assert {r.doc_id for r in retrieval.bm25(index, asked, 9, among=F.col("dept") == "a").collect()} == {1, 3, 5}
    assert retrieval.bm25(index, asked.limit(0), 3).count() == retrieval.bm25(docs.limit(0), asked, 3).count() == 0


def test_pruned_search_equals_model_and_reads_less(spark):
    rng = random.Random(4)
    common, rare = [f"c{chr(97 + i)}" for i in range(6)], ["".join(rng.choices("ghijkl", k=5)) for _ in range(300)]
    topics = [["t" + "".join(rng.choices("abcdef", k=4)) for _ in range(9)] for _ in range(20)]
    docs = [(i, " ".join([*rng.choices(common, k=rng.randrange(4)), *rng.choices(topics[i % 20], k=rng.randrange(3, 30)), *rng.choices(rare, k=rng.randrange(3))])) for i in range(1200)]
    docs += [(2000 + i, docs[7][1]) for i in range(5)] + [(3000, None), (7, docs[7][1])]  # copies, a repeated id
    queries = [" ".join([*rng.sample(common, 2), *rng.sample(topics[i], 2), *rng.sample(rare, i % 2)]) for i in range(12)] + [rare[0], "nowhere", common[0]]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    frame = spark.createDataFrame([(i, t, ("a", "b", None)[i % 3]) for i, t in docs] + [(None, rare[0], "a")], "doc_id long, text string, dept string").repartition(3)
    index, read = retrieval.build_index(frame, keep=["dept"], cell_docs=16), {}
    found = {}
    for r in inverted.search(index, asked, 5, read=read).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.doc_id, r.score))
    every = [*docs[:-1], (-1, docs[-1][1]), (-2, rare[0])]  # the model needs ids of their own
    for q, words in enumerate(queries):
        want = [(7 if i == -1 else i, s) for i, s in okapi([(i, t or "") for i, t in every], words.split()) if i != -2]
        want.sort(key=lambda p: (-p[1], p[0]))
        assert found[q] == want[:5], words
    assert read["read"] < 0.75 * read["blocks"]
    inverted.search(index, asked.where(F.col("query_id") == 12), 1, read=read)
    assert 0 < read["read"] <= 2 * inverted.SEEDS
    alone = inverted.search(index, asked, 5, among=F.col("dept") == "a").collect()
    dept = {i: ("a", "b", None)[i % 3] for i, _ in docs}
    assert all(dept[r.doc_id] == "a" for r in alone) and len(alone) == 5 * len(queries)


def test_tokens_in_python_and_spark(spark):
    texts = ["Ab_1 c-d", "全大運 x全y", "", "É ñ ü9", "漢 字字"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.index_tokens(F.col("t")).alias("tokens")).collect()
    assert all(r.tokens == inverted.index_tokens(r.t) for r in rows)


class Failing(Offline):
    def relevance(self, query, body):
        return F.lit(None).cast("double")


def test_retrieve_filters_and_fails_softly(spark):
    docs = spark.createDataFrame([(i, f"word number{i}", "a" if i % 2 else "b") for i in range(30)], "doc_id long, text string, dept string")
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(1, "number7 word", [20.2, 0.0])], "query_id long, query string, vector array<double>")
    rows = retrieval.retrieve(docs, vectors, asked, Offline(), 4, dept="a").orderBy("position").collect()
    assert len(rows) == 4 and rows[0].doc_id == 7 and all(r.doc_id % 2 for r in rows)
    plain = retrieval.retrieve(docs, vectors, asked, Offline(), 4, use_rerank=False).orderBy("position").collect()
    assert [r.doc_id for r in plain] == [20, 7, 21, 0] and plain[0].rerank_score is None
    failed = retrieval.retrieve(docs, vectors, asked, Failing(), 4).orderBy("position").collect()
    assert [r.doc_id for r in failed] == [20, 7, 21, 0]
    assert retrieval.retrieve(docs, vectors.limit(0), asked, Offline(), 4).count() == 0


def ranked(spark, docs):
    return spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(docs)], "query_id long, doc_id long, rank int")


def test_fusion_is_best_rank_not_a_sum(spark):
    rows = retrieval.fuse_best_rank([ranked(spark, [7, 8]), ranked(spark, [9, 7])], 10).orderBy("position").collect()
    assert [(r.doc_id, r.best_rank) for r in rows] == [(7, 1), (9, 1), (8, 2)]


def test_rerank_short_scores_and_failure(spark):
    rows = ranked(spark, [5, 6, 7])
    cut = retrieval.rerank_scores(rows, F.array(F.lit(0.1), F.lit(0.9)), 8).orderBy("position").collect()
    assert [r.doc_id for r in cut] == [6, 5]
    failed = retrieval.rerank_scores(rows, F.lit(None).cast("array<double>"), 8).orderBy("position").collect()
    assert [r.doc_id for r in failed] == [5, 6, 7]


def test_variants(spark):
    row = spark.range(1).select(retrieval.query_variants(F.lit("q"), F.array(*map(F.lit, ["a", "q", "b", "c", "d"])), F.lit("h")).alias("v")).first()
    assert row.v == ["q", "a", "b", "c", "d"]


def test_retrieval_reaches_documents_without_a_vector(spark, tmp_path):
    docs = [(1, "plain words here"), (2, "other words there"), (3, "zebra quagga okapi"), (4, "more words"), (5, "last words")]
    spark.createDataFrame([(i, t, "src1", "en", len(t)) for i, t in docs], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "zebra quagga"), (9, "okapi zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = queries.retrieve_and_rerank(spark, str(tmp_path)).collect()
    assert {(r.query_id, r.doc_id, r.rerank_score) for r in rows if r.position == 1} == {(1, 3, 1.0), (9, 3, 1.0)}
    assert {r.doc_id for r in rows if r.query_id == 1} == {1, 2, 3, 4, 5}


class Rewriting(Offline):
    def rewrites(self, query):
        return F.array(F.lit("okapi"), F.lit("far"))

    def embed(self, text, own):
        return F.when(text == "far", F.array(F.lit(100.0), F.lit(0.0))).otherwise(own)


def test_variants_reach_both_lists(spark, tmp_path):
    docs = [(i, f"filler number{i}") for i in range(60)] + [(60, "okapi"), (61, "distant"), (-7, "zebra")]
    spark.createDataFrame([(i, t, "src1", "en", len(t)) for i, t in docs], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [100.0 if i == 61 else i / 100, 0.0]) for i, _ in docs], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(-7, "zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {name: {r.doc_id for r in queries.retrieve_and_rerank(spark, str(tmp_path), models).collect()} for name, models in (("plain", Offline()), ("rewritten", Rewriting()))}
    assert -7 in found["plain"] and not {60, 61} & found["plain"]
    assert {-7, 60, 61} <= found["rewritten"]


def test_cells_are_stored_in_small_row_groups(spark, monkeypatch):
    """A reader decodes a row group of cells at once, so its size bounds what a task holds."""
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    monkeypatch.setattr(inverted, "SMALL", 0)  # one task writes all
    word = F.concat(F.lit("w"), F.conv(F.substring(F.md5(F.concat_ws("/", "id", "i")), 1, 10), 16, 36))
    docs = spark.range(1500).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(1000)))).groupBy("id").agg(F.concat_ws(" ", F.collect_list(word)).alias("text"))
    index = retrieval.build_index(docs.coalesce(1).withColumnRenamed("id", "doc_id"))
    sizes = []
    for path in index.cells.inputFiles():
        told = pq.ParquetFile(urlparse(path).path).metadata
        sizes += [told.row_group(i).total_byte_size for i in range(told.num_row_groups)]
    assert sum(sizes) > 16 << 20 and max(sizes) < 12 << 20, sizes
    assert index.sizes()[1:] == (1500, 1_500_000)


def test_a_read_of_cells_holds_about_what_is_stored(spark):
    """Lists cost a reader eight bytes of levels for each value, so postings and terms are no lists."""
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("id", "i"), F.lit(3000)).cast("string"))
    docs = spark.range(600).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(500)))).groupBy("id").agg(F.concat_ws(" ", F.collect_list(word)).alias("text"))
    index = retrieval.build_index(docs.withColumnRenamed("id", "doc_id"))
    values = tokens = terms = 0
    for path in index.cells.inputFiles():
        told = pq.ParquetFile(urlparse(path).path).metadata
        values += sum(told.row_group(i).column(c).num_values for i in range(told.num_row_groups) for c in range(told.num_columns))
    for r in index.cells.collect():
        tokens, terms = tokens + r.n_tokens, terms + len(r.ends)
        assert len(r.terms.split(" ")) == len(r.ends) and len(r.places) == len(r.tfs) == r.ends[-1]  # a byte each
    assert tokens == 600 * 500 and values < terms + 10 * 600, (values, terms)


def test_cells_of_many_documents_and_repeats(spark):
    """Numbers over 255 take more bytes; documents without a word have none."""
    texts = [(i, "far " * (i % 3) + "near " * (300 if i == 7 else 1)) for i in range(400)] + [(400, ""), (401, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = retrieval.build_index(docs.coalesce(1), cell_docs=1000)
    asked = spark.createDataFrame([(1, "near"), (2, "far near")], "query_id long, query string")
    found = [(r.query_id, r.doc_id, r.score) for r in inverted.search(index, asked, 402).orderBy("query_id", "rank").collect()]
    for q, words in ((1, ["near"]), (2, ["far", "near"])):
        want = sorted(okapi([(i, t or "") for i, t in texts], words), key=lambda p: (-p[1], p[0]))
        assert [(i, s) for n, i, s in found if n == q] == want


def test_equal_vectors_are_compared_in_parts():
    """Among equal vectors every pair is near, and the differences of all would be held at once."""
    import tracemalloc

    import pyarrow as pa

    from kelpline.operators.neighbours import _near

    vectors = pa.array([[float(c) for c in range(64)]] * 4096, pa.list_(pa.float64()))
    left, right = pa.table({"doc_id": range(4096), "vector": vectors}), pa.table({"query_id": range(128), "vector": vectors.slice(0, 128)})
    tracemalloc.start()
    found = _near(3)(left, right)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.column("doc_id").to_pylist() == [0, 1, 2] * 128 and set(found.column("distance").to_pylist()) == {0.0}
    assert most < 200 << 20, most


def _shuffled(spark):
    """Bytes that the application has shuffled so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    executors = context.statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def _held(spark, folder):
    """Documents of 20 kB that do not compress, an index of their first words, and questions. Each document is a cell."""
    noise = lambda i: F.concat(*[F.sha2(F.concat_ws(" ", "id", F.lit(j)), 512) for j in range(i)])
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.col("id") % 30, F.lit(" "), noise(160)).alias("text"))
    docs.write.parquet(str(folder / "docs"))
    docs = spark.read.parquet(str(folder / "docs"))
    index = retrieval.build_index(docs.select("doc_id", F.substring("text", 1, 11).alias("text")), cell_docs=1)
    return docs, index, spark.range(40).select((F.col("id") % 40).alias("query_id"), F.concat(F.lit("common w"), F.col("id") % 30).alias("query"))


def _without_broadcast_of(spark, size, job):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    try:
        before = _shuffled(spark)
        rows = job()
        return rows, _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_that_were_not_found_are_not_shuffled(spark, tmp_path):
    docs, index, _ = _held(spark, tmp_path)
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("common w"), F.col("id") % 30).alias("query"))
    found, size = _without_broadcast_of(spark, "4k", lambda: retrieval.bm25(index, asked, 2).join(docs, "doc_id").select("query_id", F.length("text").alias("n")).collect())
    assert len(found) == 400 and min(r.n for r in found) > 20_000
    assert size < 2_000_000  # the texts have 6 MB


def test_retrieval_shuffles_texts_that_were_found(spark, tmp_path):
    docs, index, asked = _held(spark, tmp_path)
    vectors = spark.range(1).select(F.col("id").alias("doc_id"), F.array(F.lit(0.0)).alias("vector"))
    one = asked.where("query_id = 7").withColumn("vector", F.lit(None).cast("array<double>"))
    found, size = _without_broadcast_of(spark, "12k", lambda: retrieval.retrieve(index, vectors, one, Offline(), k=2, bodies=docs).collect())
    assert len(found) == 2 and size < 2_000_000
