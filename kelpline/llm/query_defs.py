"""One thin query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import toxicity
from kelpline.llm.bpe import encode_decode
from kelpline.llm.embedding_dedup import near_duplicates
from kelpline.llm.fingerprints import with_next
from kelpline.llm.hard_negatives import mine
from kelpline.llm.jaccard_join import similar_documents
from kelpline.llm.langid import identify, learn, remainder
from kelpline.llm.mixing import documents_by_position, mix_sources
from kelpline.llm.runs import find_runs
from kelpline.llm.secrets import find_secrets
from kelpline.llm.sharding import shard_by_bytes
from kelpline.llm.topk_search import top_k
from kelpline.llm.url_filter import judge_urls
from kelpline.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


@query(
    "op7_url_filter",
    r"""
    WITH rules(verdict, host, path) AS (VALUES
        ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
        ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    seen AS (
        SELECT page_id, row_number() OVER () AS row_no,
               coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    met AS (
        SELECT s.row_no, r.host || r.path AS rule, r.verdict,
               row_number() OVER (PARTITION BY s.row_no ORDER BY length(r.host || r.path) DESC) AS place
        FROM seen s JOIN rules r
          ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
    SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
    FROM seen s LEFT JOIN met m ON m.row_no = s.row_no AND m.place = 1
    """,
)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


@query(
    "op1_sharding",
    r"""
    WITH codes AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
            lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS code),
    d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
    bytes AS (SELECT n, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM d),
    sums AS (SELECT n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], b),
            lambda c, x: xor(c >> 8, code[1 + (xor(c, x) & 255)]))) AS crc FROM bytes, codes),
    s AS (SELECT doc_id, crc, t, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size FROM d JOIN sums USING (n)),
    o AS (SELECT *, row_number() OVER w AS place, CAST(sum(size) OVER w - size AS BIGINT) AS start FROM s
        WINDOW w AS (ORDER BY crc, t, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    g AS (SELECT crc, t, min(start) AS first, max(start + size) AS last FROM o GROUP BY crc, t),
    goals AS (SELECT CAST(k * total // 8 AS BIGINT) AS goal, total / 8 AS target FROM (SELECT sum(size) AS total FROM s), (SELECT unnest(range(1, 8)) AS k)),
    near AS (SELECT goal, target, CASE WHEN abs(g.first - goal) <= abs(g.last - goal) THEN g.first ELSE g.last END AS edge,
            CASE WHEN abs(o.start - goal) <= abs(o.start + o.size - goal) THEN o.start ELSE o.start + o.size END AS row_edge
        FROM goals JOIN o ON o.start <= goal AND goal < o.start + o.size JOIN g ON g.crc = o.crc AND g.t = o.t),
    cuts AS (SELECT CASE WHEN abs(edge - goal) > 0.02 * target THEN row_edge ELSE edge END AS cut FROM near),
    cast_ AS (SELECT doc_id, size, crc, place, (SELECT count(*) FROM cuts WHERE cut <= o.start) AS shard FROM o)
    SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
        place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cast_
    """,
)
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


@query(
    "op2_mixing",
    r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
            md5(coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || coalesce(source, '~') || '|' || coalesce(text, '~')) AS place FROM documents),
    o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS begin FROM d),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS own, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
    w AS (SELECT *, 1.0::DOUBLE + i % 3 AS weight, row_number() OVER r AS turn, coalesce(sum(3 * own) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
            sum(1.0::DOUBLE + i % 3) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, sum(own) OVER () AS total FROM s
        WINDOW r AS (ORDER BY own / (1.0::DOUBLE + i % 3), i)),
    c AS (SELECT *, (total - capped)::DOUBLE / weights AS scale FROM w),
    f AS (SELECT min(turn) AS turn FROM c WHERE scale * weight <= 3 * own),
    t AS (SELECT c.source, c.own, c.i, CASE WHEN c.turn < f.turn THEN (3 * c.own)::DOUBLE ELSE (SELECT scale FROM c x WHERE x.turn = f.turn) * c.weight END AS target FROM c, f),
    m AS (SELECT o.doc_id, o.size, t.own, t.target, t.i % 3 AS kind, o.begin, CAST(round(t.target) AS BIGINT) AS wanted FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
    p AS (SELECT *, greatest(least(wanted - begin, size), 0) AS a, greatest(least(wanted - own - begin, size), 0) AS b, greatest(least(wanted - 2 * own - begin, size), 0) AS c,
            greatest(begin / wanted, 0.0) AS need FROM m)
    SELECT doc_id, size, own AS source_size, target, CAST(a + b + c AS BIGINT) AS taken, CAST((a > 0)::INTEGER + (b > 0)::INTEGER + (c > 0)::INTEGER AS INTEGER) AS passes,
        CASE WHEN a > 0 THEN CASE kind WHEN 0 THEN 2 * need / (1.5 + sqrt(greatest(2.25 + -2.0 * need, 0.0))) WHEN 1 THEN 2 * need / (1.0 + sqrt(1.0::DOUBLE))
            ELSE CASE WHEN need > 0.3125 THEN 0.5 + 2 * (need - 0.3125) / (1.0 + sqrt(1.0 + 3.0 * (need - 0.3125))) ELSE 2 * need / (0.25 + sqrt(0.0625 + 3.0 * need)) END END END AS position
    FROM p
    """,
)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = documents_by_position(mix_sources(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "passes", "position")


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return encode_decode(table(spark, sf_dir, "documents"), file.read(), digests=True)


@query("op9_langid")
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, remainder(F.col("doc_id"), 3) != 1)
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return identify(docs, model).select("doc_id", held, "lang_pred", "score", "rejected")


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), remainder(F.col("id"), 4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query(
    "op8_topk_search",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    asked AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
    scored AS (
        SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
               CAST(coalesce(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
        FROM asked q JOIN v d ON d.vec_id <> q.vec_id),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
    """,
)
def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query(
    "op6_embedding_dedup",
    """
    WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS n, * FROM embeddings),
    v AS (
        SELECT n, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM numbered
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS (SELECT *, sqrt(list_dot_product(e, e)) AS length FROM v),
    pairs AS (SELECT a.n AS a, b.n AS b, b.vec_id AS id FROM s a JOIN s b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e)
        WHERE list_dot_product(a.e, b.e) / (a.length * b.length) >= 0.98),
    reach AS (SELECT n AS node, vec_id AS least FROM s UNION SELECT p.a, r.least FROM reach r JOIN pairs p ON p.b = r.node),
    least AS (SELECT node, min(least) AS least FROM reach GROUP BY node),
    links AS (SELECT a AS node, count(*) AS links FROM pairs GROUP BY a)
    SELECT e.vec_id, coalesce(l.links, 0) AS n_links, coalesce(c.least, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(c.least, e.vec_id), true) AS kept
    FROM numbered e LEFT JOIN links l ON l.node = e.n LEFT JOIN least c ON c.node = e.n
    """,
)
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    "op5_jaccard_join",
    r"""
    WITH RECURSIVE w AS (
        SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    sets AS (SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    items AS (SELECT n, doc_id, len(s) AS size, unnest(s) AS item FROM sets),
    shared AS (SELECT a.n AS a, b.n AS b, any_value(a.doc_id) AS x, any_value(b.doc_id) AS y, any_value(a.size) AS p, any_value(b.size) AS q, count(*) AS met
        FROM items a JOIN items b ON a.item = b.item AND a.n <> b.n GROUP BY a.n, b.n),
    links AS (SELECT a, b, x, y FROM shared WHERE 100 * met >= 80 * (p + q - met)),
    reach AS (SELECT a AS node, x AS least FROM links UNION SELECT l.a, r.least FROM reach r JOIN links l ON l.b = r.node),
    least AS (SELECT node, min(least) AS least FROM reach GROUP BY node)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least(c.least, s.doc_id), s.doc_id) AS component_id FROM sets s LEFT JOIN least c ON c.node = s.n
    """,
)
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


@query(
    "op11_hard_negatives",
    """
    WITH v AS (
        SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    one AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, e) = 1),
    scored AS (
        SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same,
               CAST(coalesce(list_sum(list_transform(list_zip(a.e, o.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
        FROM one a JOIN one o ON o.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 10
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


@query("op12_fingerprints")
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"), digests=True).withColumnRenamed("edited", "edited_sha256")


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in the texts of about a tenth of the documents the words from one place on are made periodic."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    placed = chosen.selectExpr("*", "h div 10 AS g", "size(words) AS n").selectExpr("*", "CASE WHEN n > 0 THEN g % n END AS a")
    placed = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    bent = F.expr("array_join(transform(sequence(0, n - 1), i -> words[CASE WHEN i >= a THEN int(a + (i - a) % p) ELSE i END]), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, bent).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_repeats(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(F.encode(lines, "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"))
    told = told.select("doc_id", "n_runs", F.col("longest.start").alias("start"), (-F.col("longest.less")).alias("length"), F.col("longest.period").alias("period"), "runs_sha256", "collapsed_sha256")
    return told.withColumn("exponent_milli", F.expr("1000 * length div period"))
