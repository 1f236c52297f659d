from pyspark.sql import functions as F

from kelpline.operators import lookup


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, text string, date string, dept string, url string")


def test_latest_and_keyword(spark):
    rows = docs(spark, [(0, "a", "x", "2024 / 01 / 01", "ge", ""), (1, "a", "y", "2024 / 02 / 01", "ge", ""), (2, "b", "z", "", "lc", ""), (3, "c", "en", "2023", "ge", "")])
    assert [r.doc_id for r in lookup.latest_news(rows).collect()] == [1, 3, 2]
    assert [r.doc_id for r in lookup.latest_news(rows, dept="lc").collect()] == [2]
    # "nc" occurs only across the seam of body and title: the gate passes, the score is zero
    assert [(r.doc_id, r.score) for r in lookup.keyword_news(rows, "NC").collect()] == [(3, 0)]
    assert lookup.keyword_news(rows, "!!").count() == 0


def test_forms(spark):
    rows = docs(spark, [(i, "form" if i < 10 else f"t{i}", "body", "", "", "u") for i in range(30)])
    assert lookup.find_forms(rows, "").count() == 11  # 20 rows, of which ten are one
    found = [(r.doc_id, r.score) for r in lookup.find_forms(rows, "FORM").collect()]
    assert found == [(0, 3)]
    assert lookup.find_forms(rows, "body").count() == 20


def test_records(spark):
    rows = docs(spark, [(i, "", f"record {112 if i % 2 else 'year 2023'} name{i % 3}", "", "", "") for i in range(40)])
    assert lookup.find_records(rows, year="112").first().total == lookup.find_records(rows, year="2023").first().total == 40
    assert lookup.find_records(rows, year="2023").count() == 25
    assert lookup.find_records(rows, year="112x").count() == lookup.find_records(rows, year="²").count() == 0
    relaxed = lookup.find_records(rows, keyword="absent", name="name").collect()
    assert len(relaxed) == 15 and {r["mode"] for r in relaxed} == {"relaxed"}
    assert lookup.find_records(rows, keyword="absent").count() == 0
    assert lookup.find_records(rows, keyword="absent/record").first()["mode"] == "strict"


def test_schedule(spark):
    rows = docs(spark, [(0, "課表", "113", "2024", "", ""), (1, "x", "課程表 110", "2025", "", ""), (2, "x", "none", "2026", "", "")])
    assert lookup.schedule(rows).first().doc_id == 1
    assert (lookup.schedule(rows, 2024).first().doc_id, lookup.schedule(rows, 1990).first().exact) == (0, False)


def test_professors(spark):
    rows = spark.createDataFrame([(1, "師資介紹", "swims"), (2, "other", "swims")], "doc_id long, page string, text string")
    assert [r.doc_id for r in lookup.find_professors(rows, "swim").collect()] == [1] and lookup.find_professors(rows, "").count() == 0


def test_sources(spark):
    hits = spark.createDataFrame(
        [(1, 1, "1. Alpha form.pdf", "http://a", "form", ""), (1, 2, "Beta", "http://b", "page", ""), (1, 3, "C", "", "correction", ""), (1, 4, "1. Alpha form.pdf", "http://a", "form", "")],
        "query_id long, rank int, title string, url string, type string, page string",
    )
    listed = lookup.list_sources(hits)
    assert len(listed.first().candidates) == 2
    tell = lambda answer: [s.title for s in lookup.attribute_sources(listed.withColumn("answer", F.lit(answer))).first().sources]
    assert tell("see Alpha form") == ["1. Alpha form.pdf"]
    assert tell("see http://a") == []
    assert tell("neither") == ["1. Alpha form.pdf", "Beta"]
    assert tell("查無資料") == []
