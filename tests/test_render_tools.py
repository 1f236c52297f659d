import json

from pyspark.sql import functions as F

from kelpline.operators import render
from kelpline.plans import tools
from kelpline.sources import markdown, sinks


def rows(spark):
    data = [
        (0, "Alpha", "see [x](http://u/1) now", "2024 / 01 / 01", "ge", "http://a", "news", "法規", "regulations", "p"),
        (1, "Beta form", "body " * 50, None, "lc", "", "form", "表單", "", "p"),
        (2, "課表", "113 課程表", "2025", "ge", "", "page", "", "", "p"),
        (3, "Run", "record 112 Ann", "", "ope", "", "grade", "", "", "p"),
    ]
    return spark.createDataFrame(data, "doc_id long, title string, text string, date string, dept string, url string, type string, category string, source string, page string")


def test_lists(spark):
    hits = rows(spark).where("doc_id < 2").withColumns({"query_id": F.lit(1), "rank": F.col("doc_id")})
    assert render.bullet_list(hits).first().text.split("\n")[0] == "- **Alpha** — 2024 / 01 / 01  [x](http://u/1) [法規文件]"
    assert "【日期】：未註明日期\n【標題】：Beta form" in render.news_list(hits).first().text
    listing = render.fallback_list(hits.union(hits.withColumn("rank", F.lit(9)))).first().text
    assert listing.count("Alpha") == 1 and listing.endswith("...") and "連結：http://a" in listing


def test_titles_and_times(spark):
    context = "Title: T1\n【標題】：T2\n- **T1** - **T3**賽事名稱：T4，"
    frame = spark.createDataFrame([(context, ["t"]), ("", ["a", "b"]), (None, [])], "c string, t array<string>")
    assert [r.x for r in frame.select(render.harvested_titles(F.col("c"), F.col("t")).alias("x")).collect()] == ["T1 | T2 | T3 | T4", "使用工具: a, b", render.NO_TOOL]
    stages = spark.range(1).select(render.stage_seconds(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.struct(i.alias("stage"), F.lit(1.0).alias("seconds")))).alias("s"))
    assert stages.first().s == 50.0


def test_tools(spark):
    docs = rows(spark)
    assert [r.doc_id for r in tools.call(docs, "get_latest_news", {}).collect()] == [0]
    assert [r.doc_id for r in tools.call(docs, "get_schedule", {"year": 2024}).collect()] == [2]
    assert [r.doc_id for r in tools.call(docs, "get_competition_records", {"year": "2023", "name": "Ann"}).collect()] == [3]
    assert [r.doc_id for r in tools.call(docs, "find_forms", {"keyword": "beta"}).collect()] == [1]
    assert tools.call(docs, "search_regulations_and_general", {"search_query": "record ann"}).orderBy("position").first().doc_id == 3
    assert tools.call(docs, "unknown", {}).count() == 0


def test_tool_arguments_and_corrections(spark, tmp_path):
    assert tools.schema_of("record_correction")["required"] == ["original_query", "correction_info"] and tools.schema_of("get_schedule")["properties"] == {"year": {"type": "integer"}}
    assert tools.parse("get_schedule", '{"year": 2024, "other": 1}') == {"year": 2024} and tools.parse("get_schedule", '{"year": "x"}') == {}
    assert tools.parse("get_schedule", '{"year": " 2024 "}') == {"year": 2024} and tools.parse("get_schedule", '{"year": true}') == {} and tools.parse("get_competition_records", '{"year": 2024}') == {"year": "2024"}
    assert [tools.parse("find_forms", a) for a in ("broken", None, "[1]", '{"keyword": "k"}')] == [{}, {}, {}, {"keyword": "k"}]
    docs = rows(spark)
    vectors = spark.createDataFrame([(3, [0.0, 1.0])], "doc_id long, vector array<double>")
    base = tools.Knowledge(docs, vectors, str(tmp_path / "c"), dept="ge")
    assert tools.call(base, "record_correction", '{"original_query": "q", "correction_info": "i"}').first().recorded
    assert [r.dept for r in markdown.corrections(markdown.read_files(spark, [str(tmp_path / "c")])).collect()] == ["ge"]
    assert [r.dept for r in tools.call(base, "search_regulations_and_general", '{"search_query": "alpha"}').collect()] == ["ge", "ge"]
    assert [r.doc_id for r in tools.call(base, "get_schedule", '{"year": 2024}').collect()] == [2]
    assert spark.table(tools.register(spark, base)[0]).count() == 1


def test_more_sinks(spark, tmp_path):
    line = json.loads(sinks.event_line(spark.createDataFrame([("x",)], "a string"), "feedback", F.lit("2024-01-02 03:04:05").cast("timestamp")).first().value)
    assert line["ts"].startswith("2024-01-02T03:04:05")
    corrections = spark.createDataFrame([("GE", "t", "yes"), ("zz", "t", "yes"), ("ge", "t", "no")], "dept string, topic string, text string")
    sinks.record_corrections(corrections, F.col("text") == "yes", str(tmp_path / "c"))
    found = markdown.corrections(markdown.read_files(spark, [str(tmp_path / "c")])).collect()
    assert sorted(r.dept for r in found) == ["ge", "ope"] and all("- **正確資訊**：yes" in r.text for r in found)
    sinks.write_results(corrections.limit(1), corrections, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/rows")).count() == 3
