"""Bulk lookups against the single ones, request by request."""

import random

import pytest

from kelpline.operators import bulk, lookup


@pytest.fixture
def docs(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "2024", "113", "全大運", "全國大專校院運動會", "aa", "aaaa", "ann"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(12))) if i % 17 else None
        rows.append((i, rng.choice(["alpha", "t1", "t2", "全大", None]), text, rng.choice(["2024 / 01 / 02", "2023 / 11 / 30", None, ""]), rng.choice(["ge", "lc"]), rng.choice(["u", "v"])))
    return spark.createDataFrame(rows, "doc_id long, title string, text string, date string, dept string, url string").repartition(5).cache()


@pytest.mark.parametrize("block,held", [(20_000, 100_000), (3, 10)])
def test_bulk_equals_single(spark, docs, monkeypatch, block, held):
    monkeypatch.setattr(bulk, "REQUESTS", block)
    monkeypatch.setattr(bulk, "HELD", held)
    asked = ["alpha", "aa aa", "Beta gamma", "全大運 aaaa", "", "nothing", "  ", "a", "t1"]
    news = spark.createDataFrame([(i, q, d) for i, q in enumerate(asked) for d in [None, "ge", "zz"][i % 3 :][:1]] + [(100, None, None), (None, "alpha", None), (0, "zzz", None)], "request_id long, query string, dept string")
    got = {}
    for r in bulk.keyword_news(docs, news, 4).orderBy("position").collect():
        got.setdefault(r.request_id, []).append((r.doc_id, r.score))
    for i, q in enumerate(asked):
        want = [(r.doc_id, r.score) for r in lookup.keyword_news(docs, q, 4, [None, "ge", "zz"][i % 3]).collect()]
        assert got.get(i, []) == want, q
    assert 100 not in got and None not in got

    forms = spark.createDataFrame(list(enumerate(asked)) + [(50, None)], "request_id long, keyword string")
    got = {}
    for r in bulk.find_forms(docs, forms, 7).orderBy("position").collect():
        got.setdefault(r.request_id, []).append((r.doc_id, r.score))
    for i, q in [*enumerate(asked), (50, "")]:
        assert got.get(i, []) == [(r.doc_id, r.score) for r in lookup.find_forms(docs, q, 7).collect()], q

    records = [("alpha", "", ""), ("全大運", "2024", ""), ("nothing", "", "ann"), ("nothing", "", ""), ("", "113", "ann"), ("", "", ""), ("alpha/gamma", "soon", ""), ("x/Beta", "2024", "ann"), (None, None, "aaaa")]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(records)], "request_id long, keyword string, year string, name string")
    got = {}
    for r in bulk.find_records(docs, table, 6, 3).orderBy("position").collect():
        got.setdefault(r.request_id, []).append((r.doc_id, r.mode, r.total))
    for i, r in enumerate(records):
        want = [(x.doc_id, x["mode"], x.total) for x in lookup.find_records(docs, *(v or "" for v in r), most=6, relaxed_most=3).collect()]
        assert got.get(i, []) == want, r


def test_bulk_of_nothing(spark, docs):
    none = spark.createDataFrame([], "request_id long, query string, dept string, keyword string, year string, name string")
    for found in (bulk.keyword_news(docs, none), bulk.find_forms(docs, none), bulk.find_records(docs, none)):
        assert found.count() == 0
    one = spark.createDataFrame([(1, "alpha", None, "alpha", "", "")], none.schema)
    for found in (bulk.keyword_news(docs.limit(0), one), bulk.find_forms(docs.limit(0), one), bulk.find_records(docs.limit(0), one)):
        assert found.count() == 0


def test_forms_that_a_task_holds_are_bounded(spark, monkeypatch):
    """The task's own function over forms of as many titles: late ones are dropped, those found by title handed on in parts."""
    import pyarrow as pa

    monkeypatch.setattr(bulk, "HELD", 100)
    frame = spark.createDataFrame([(0, "", "", "")], "doc_id long, title string, url string, text string")
    scans, real = [], type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, *a: (scans.append(f), real(self, f, *a))[1])
    bulk.find_forms(frame, spark.createDataFrame([(7, "body"), (8, "title"), (9, " ")], "request_id long, keyword string"), 5)
    made = [(i, f"title {i % 700}" if i % 2 else f"t{i % 800}", None if i % 3 else "u", "x", "body" if i % 5 else "") for i in range(3000)]
    batch = pa.table({"doc_id": [m[0] for m in made], "title": [m[1] for m in made], "url": [m[2] for m in made], "low_title": [m[1] for m in made], "low_text": [m[4] for m in made]}).to_batches()
    out = [b.to_pylist() for b in scans[0](iter(batch))]
    assert max(map(len, out)) <= 3 * 100
    want = {7: 5, 8: None, 9: 5}
    for request, rows in want.items():
        met, every = {}, {}
        for r in sorted((r for part in out for r in part if r["request_id"] == request), key=lambda r: r["doc_id"]):
            met.setdefault((r["title"], r["url"]), (-r["score"], r["doc_id"]))
        for i, title, url, _, text in made:
            score = {7: text == "body", 8: 3 * title.startswith("title"), 9: 4}[request]
            if score:
                every.setdefault((title, url), (-score, i))
        assert sorted(met.values())[:5] == sorted(every.values())[:5]
        assert rows is None or len([r for part in out for r in part if r["request_id"] == request]) < len(every) // 3
