"""Table functions in SQL against the single lookups, alone and in lateral joins."""

import pytest

from kelpline.operators import chunking, lookup
from kelpline.plans import table_functions


@pytest.fixture
def docs(spark):
    rows = [
        (1, "ge", "news", "", "Alpha day", "u1", "2024 / 01 / 02", "alpha beta alpha"), (2, "lc", "news", "", "Alpha day", "u2", "2024 / 03 / 02", "beta"), (3, "ge", "news", "", "Other", "u3", "2023 / 03 / 02", None),
        (4, "ge", "form", "表單", "Alpha form", "f1", "", "use alpha"), (5, "ge", "form", "表單", "Alpha form", "f1", "", "alpha again"), (6, "ge", "form", "表單", "Beta form", "f2", "", "ALPHA"), (7, "ge", "form", "表單", None, "f3", "", "x"),
        (8, "ge", "page", "", "體育課表 2023", "p", "2023 / 09 / 01", "課程"), (9, "ge", "page", "", "課表", "p", "2024 / 09 / 01", "課程表 113"),
        (10, "ge", "grade", "", "g", "", "", "全國大專校院運動會 Ann 2024"), (11, "ge", "grade", "", "g", "", "", "alpha Ann 113"), (12, "ge", "grade", "", "g", "", "", "alpha Bob 112"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, dept string, type string, category string, title string, url string, date string, text string")
    table_functions.register(spark, frame, "t_")
    return frame


def test_functions_equal_lookups(spark, docs):
    forms, news, grades = docs.where("category = '表單'"), docs.where("type = 'news'"), docs.where("type = 'grade'")
    for word in ("alpha", "ALPHA ", "nothing", ""):
        want = [(r.doc_id, r.score) for r in lookup.find_forms(forms, word).collect()]
        assert [(r.doc_id, r.score) for r in spark.sql(f"SELECT * FROM t_find_forms('{word}')").collect()] == want
        want = [r.doc_id for r in (lookup.keyword_news(news, word) if word else lookup.latest_news(news)).collect()]
        assert [r.doc_id for r in spark.sql(f"SELECT * FROM t_get_latest_news('{word}')").collect()] == want
    assert [r.doc_id for r in spark.sql("SELECT * FROM t_get_latest_news(of_dept => 'lc')").collect()] == [2]
    assert len(spark.sql("SELECT * FROM t_find_forms()").collect()) == 3
    for year in ("NULL", "2023", "2024", "1999"):
        want = [(r.doc_id, r.exact) for r in lookup.schedule(docs, None if year == "NULL" else int(year)).collect()]
        assert [(r.doc_id, r.exact) for r in spark.sql(f"SELECT * FROM t_get_schedule({year})").collect()] == want
    for asked in (("alpha", "", ""), ("全大運", "", ""), ("zzz", "", "Ann"), ("zzz", "", ""), ("", "2024", ""), ("", "soon", ""), ("", "", ""), ("x/alpha", "113", "Bob")):
        want = sorted(tuple(r) for r in lookup.find_records(grades, *asked).collect())
        assert sorted(tuple(r) for r in spark.sql("SELECT * FROM t_get_competition_records('{}', '{}', '{}')".format(*asked)).collect()) == want, asked


def test_lateral_joins(spark, docs):
    spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "nothing"), (4, None)], "id int, word string").createOrReplaceTempView("asked")
    got = spark.sql("SELECT id, f.doc_id, f.score FROM asked, LATERAL t_find_forms(word) f").collect()
    forms = docs.where("category = '表單'")
    want = [(i, r.doc_id, r.score) for i, w in ((1, "alpha"), (2, "beta"), (3, "nothing"), (4, "")) for r in lookup.find_forms(forms, w).collect()]
    assert sorted(map(tuple, got)) == sorted(want)
    got = spark.sql("SELECT id, n.doc_id FROM asked LEFT JOIN LATERAL t_get_latest_news(word) n").collect()
    assert {(r.id, r.doc_id) for r in got} == {(1, 1), (2, 2), (3, None), (4, 2), (4, 3)}


def test_lateral_join_lowers_each_document_once(spark, docs):
    spark.createDataFrame([(1, "alpha"), (2, "beta")], "id int, word string").createOrReplaceTempView("asked")
    plan = spark.sql("SELECT id, f.doc_id FROM asked, LATERAL t_find_forms(word) f")._jdf.queryExecution().optimizedPlan().toString()
    met = [line for line in plan.splitlines() if "Contains(" in line]
    assert met and not any("lower(coalesce(title" in line or "lower(coalesce(text" in line for line in met)


def test_python_table_functions(spark, docs):
    long = ("word " * 30 + "\n\n") * 20
    spark.createDataFrame([(1, long), (2, None), (3, "short")], "id int, text string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT id, c.* FROM texts, LATERAL t_chunks(text) c ORDER BY id, chunk_id").collect()
    assert [r.chunk for r in rows if r.id == 1] == chunking.split_recursively(long) and [(r.id, r.chunk) for r in rows if r.id != 1] == [(3, "short")]
    assert spark.sql("SELECT * FROM t_chunks('a b', 800, true)").first().chars == 3
    assert [r.token for r in spark.sql("SELECT * FROM t_tokens('Ab 全大運') ORDER BY position").collect()] == ["ab", "全大", "大運"]
