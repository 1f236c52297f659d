"""BPE, similarity joins and search against brute force, with edge cases."""

import hashlib
import re
import struct

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kelpline.llm import bpe, components, embedding_dedup, jaccard_join, topk_search
from kelpline.session import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_equals_library(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [
        None, "", " ", "  two  spaces \n\n lines\t\tend ", "a b　 c\x1c .\x1c x", "<|endoftext|>foo <|endoftext|> \n\n  bar<|endoftext|>",
        "it's 12'll    日本語 \r\n y", "x" * 30_000, "\u0085 a   b    c", "été 🎉🎉 ok", "same text here", "same text here", "\n", "a   b",
    ]
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(10, texts[10], 0, "x"), (None, "no id", 0, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, block int, codes string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    with open(VOCABULARY, encoding="utf-8") as file:
        content = file.read()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = []
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    for size in (bpe.BLOCK_BYTES, 64):  # one block, and blocks of a text or two
        got = [tuple(r) for r in bpe.encode_decode(docs, content, digests=True, block_bytes=size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    round_trip = {r.doc_id: r.decoded.decode() for r in bpe.encode_decode(docs, content).collect()}
    assert round_trip[9] == texts[9] and round_trip[0] == ""
    assert bpe.encode_decode(docs.limit(0), content).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_packing(seed):
    rng = np.random.default_rng(seed)
    for values in (np.zeros(0, np.uint32), rng.integers(0, 1 << 32, 1000, np.uint64), np.array([0, 127, 128, 16383, 16384, (1 << 32) - 1])):
        assert np.array_equal(bpe._unpack(bpe._pack(values)), values.astype(np.uint32))


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_components(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_copies(rng):
    words = np.array([f"w{i}" for i in range(4000)])
    passage = list(rng.choice(words, 60))
    texts = []
    for _ in range(25):
        base = list(rng.choice(words, rng.integers(3, 150))) + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.integers(1, 9)):
            own = list(base)
            for _ in range(rng.integers(0, max(1, len(own) // 40) + 1)):
                own[rng.integers(len(own))] = str(rng.choice(words))
            texts.append(" ".join(own).upper() if rng.random() < 0.2 else "\t".join(own))
    big = list(rng.choice(words, 120))
    for _ in range(60):  # a large group whose members link with some of it only
        own = list(big)
        for _ in range(rng.integers(0, 5)):
            own[rng.integers(len(own))] = str(rng.choice(words))
        texts.append(" ".join(own))
    return texts + ["one two", "one two", "ONE two", "one", "a b c d e", "a b c d e f", "", None, " \n ", " ".join(passage), "x " * 20_000, "x y " * 10_000]


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_join_equals_brute_force(spark, seed, monkeypatch):
    texts = near_copies(np.random.default_rng(seed))
    rows = [(3 * i, t, 1, "n") for i, t in enumerate(texts)] + [(0, texts[0], 1, "n"), (None, texts[0], 1, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, component string")
    sets = {3 * i: shingles(t) for i, t in enumerate(texts)}
    want = brute_components(sets)
    if seed:  # a tiny order and signature must not change the result
        monkeypatch.setattr(jaccard_join, "HOT", 8)
    got = jaccard_join.similar_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[0]), None)
    kept = [r.doc_id for r in jaccard_join.one_of_each(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(want.values())) and kept.count(None) == 1


def test_jaccard_join_of_large_groups(spark, monkeypatch):
    """Sets of equal prefix and size: groups of many classes, within and between which only some pairs link."""
    rng = np.random.default_rng(5)
    common, texts = [f"c{i}" for i in range(100)], []
    for family in range(40):  # 30 rare words, more than a prefix, and 60 of a hundred common ones
        rare = [f"r{family - (family % 2 if i < 25 else 0)}_{i}" for i in range(30)]  # neighbours share 25
        if family % 2 == 0:
            first = list(rng.choice(common, 60, replace=False))
        near = [c for c in first if c not in first[:3]] + [c for c in common if c not in first][:3]
        other = list(rng.choice(common, 60, replace=False))
        texts += [" ".join(rare + own) for own in (first, near, other)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    want = brute_components({i: shingles(t, 1) for i, t in enumerate(texts)})
    seen = []
    units = jaccard_join._group_units
    monkeypatch.setattr(jaccard_join, "_group_units", lambda grouped: seen.append(grouped.agg(F.max("classes")).first()[0]) or units(grouped))
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(docs, k=1).collect()}
    assert got == want and seen[0] > 1 and 40 < len(set(want.values())) < 100


def test_jaccard_join_of_one_id_with_two_texts(spark):
    six, seven = "a b c d e f g h i j", "a b c d e f g h i j k"
    rows = [(5, six), (5, seven), (7, "q r s t u v w x y z"), (5, six), (9, "q r s t u v w x y z"), (2, "k l m n o p q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs).collect())
    assert got == [(2, 6, 2), (5, 6, 5), (5, 6, 5), (5, 7, 5), (7, 6, 7), (9, 6, 7)]
    assert sorted(map(tuple, jaccard_join.one_of_each(docs).collect())) == [(2, rows[5][1]), (5, six), (5, seven), (7, rows[2][1])]


def test_jaccard_join_without_links(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.similar_documents(docs).collect()} == {(1, 1, 1), (2, 0, 2)}
    assert jaccard_join.similar_documents(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (None, 3)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(chain, "a long, b long"), Scratch(spark)).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[200] == 200 and {got[300 + i] for i in range(30)} == {300}


def vectors(spark, extra=True):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(220):
        if i % 11 == 0:
            base = rng.normal(size=16)
        rows.append((i, [float(x) for x in np.float32(base + rng.normal(size=16) * 0.06 * (i % 11))], i % 2 if i < 200 else 5, 0))
    if extra:
        bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16]
        rows += [(300 + i, v, 1, 0) for i, v in enumerate(bad)] + [(310, rows[0][1], None, 0), (0, rows[0][1], 0, 0), (None, rows[0][1], 0, 0), (311, rows[0][1], 0, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int"), rows


def test_embedding_dedup_equals_brute_force(spark):
    table, rows = vectors(spark)
    live = [(i, np.array(v, float), label) for i, v, label, _ in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, *_ in live}
    count = {}
    for a, (i, x, k) in enumerate(live):
        hits = [b for b, (_, y, m) in enumerate(live) if a != b and k == m and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98]
        count[i] = len(hits)
        links[i] |= {live[b][0] for b in hits}

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    for options in ({}, {"cell": 20, "block": 7}):
        got = embedding_dedup.near_duplicates(table, **options).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.vec_id is not None:
                want = (count.get(r.vec_id, 0), least(r.vec_id) if r.vec_id in links else r.vec_id)
                assert (r.n_links, r.component_id, r.kept) == (*want, r.vec_id == want[1])
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_embedding_dedup_of_one_id_with_two_vectors(spark):
    def judged(rows):
        table = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
        return sorted(map(tuple, embedding_dedup.near_duplicates(table).collect()))

    east, north = [1.0, 0.0], [0.0, 1.0]
    assert judged([(1, "a", east), (1, "b", north), (2, "a", north), (3, "b", east)]) == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert judged([(5, "a", east), (5, "a", north), (6, "a", [1.0, 0.001])]) == [(5, 0, 5, True), (5, 1, 5, True), (6, 1, 5, False)]
    assert judged([(4, "a", east), (4, "b", east), (7, "b", east), (3, "a", [2.0, 0.0])]) == [(3, 1, 3, True), (4, 1, 3, False), (4, 1, 4, True), (7, 1, 4, False)]


def test_forest_recall(spark):
    """Pairs planted just above the bound, in leaves of the default size and in cells that Spark splits."""
    rng = np.random.default_rng(8)
    n, d = 3000, 32
    base = rng.normal(size=(n, d))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(n, d))
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.9801, 0.985, n)[:, None]
    twins = cosine * base + np.sqrt(1 - cosine**2) * side
    x = np.concatenate([base, twins])
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {i for i in range(n) if unit[i] @ unit[n + i] >= 0.98}
    for cell in (embedding_dedup.CELL, 1500):
        found = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(table, cell=cell).collect()}
        assert sum(found[i] == found[n + i] for i in want) / len(want) >= 0.99


def test_top_k_equals_brute_force(spark, monkeypatch):
    table, rows = vectors(spark)
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 10)
    live = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    got = {}
    for r in topk_search.top_k(table, F.col("id") % 7 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    queries = {i: x for i, x in live if i % 7 == 0}  # row 0 is there twice, as two equal queries of one id
    assert set(got) == set(queries)
    for q, x in queries.items():
        ranked = sorted(((int(x[: len(y)] @ y[: len(x)]), i) for i, y in live if i != q), key=lambda p: (-p[0], p[1]))
        assert got[q] == ranked[:5]
    assert topk_search.top_k(table.limit(0), F.col("id") % 7 == 0).count() == 0
    few = spark.createDataFrame([(7, [1.0, -0.5]), (8, [-1.0]), (9, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk_search.top_k(few, F.col("id") == 7).orderBy("rank").collect()] == [(9, 0), (8, -65536)]
    two = spark.createDataFrame([(7, [2.0]), (7, [1.0]), (8, [1.0]), (9, [1.0]), (9, [1.0])], "vec_id long, embedding array<float>")
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(two, F.col("id") == 7, k=3).orderBy("rank").collect()]
    assert found == [(7, 1, 8, 65536), (7, 2, 9, 65536), (7, 3, 9, 65536)]


@pytest.mark.parametrize("scale", [300, 1 << 28])
def test_max_score_equals_sorting_in_every_block(scale):
    rng = np.random.default_rng(scale)
    vectors = rng.integers(-scale, scale, (3000, 24)) * (rng.random((3000, 24)) < 0.5)
    vectors[100:140] = vectors[99]  # ties
    ids = rng.permutation(6000)[:3000]
    asked = np.concatenate([rng.integers(-scale, scale, (40, 24)), np.zeros((1, 24), int), vectors[99:100]])
    query_ids = np.append(rng.integers(0, 6000, 41), ids[99])
    who, what, much = topk_search.best_of(ids, vectors, query_ids, asked, 5)
    for q in range(len(asked)):
        score = vectors @ asked[q]
        want = sorted(((-int(s), int(i)) for s, i in zip(score, ids) if i != query_ids[q]))[:5]
        assert [(-int(m), int(w)) for w, m in zip(what[who == q], much[who == q])] == want


def test_one_of_each_keeps_all_columns_by_rule(spark):
    text = "a b c d e f g"
    rows = [(1, text, "z", "keep"), (1, text, "b", "x"), (1, text, "b", "w"), (2, text, "a", "y"), (3, "other words", None, "own"), (None, text, "q", "p"), (3, "other words", "n", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, _own_text string").repartition(3)
    got = sorted(map(tuple, jaccard_join.one_of_each(docs).collect()), key=str)
    assert jaccard_join.one_of_each(docs).columns == docs.columns
    assert got == sorted([(1, text, "b", "w"), (3, "other words", "n", "own"), (None, text, "q", "p")], key=str)


def test_pairs_of_repeated_long_rows(spark):
    """A row stored many times is one partner, and one pivot, in the verification."""
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words))] * 40 + [(2, " ".join([*words[:-1], "x"]))] * 40 + [(3, " ".join(words[:-9] + ["y"] * 9))] + [(4, "z " * 20)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.component_id) for r in jaccard_join.similar_documents(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
