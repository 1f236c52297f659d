import json

from pyspark.sql import functions as F

from kelpline.operators import chunking, metadata
from kelpline.sources import markdown as md
from kelpline.sources import sinks, tables


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, md string")


def test_pages_and_names(spark):
    text = "preamble\n# A \nbody\n# A\n\n# A_2\nx\n# A\nlast"
    got = [(r.page_key, r.body) for r in md.pages(files(spark, text)).orderBy("page_seq").collect()]
    assert got == [("A", "body"), ("A_2", ""), ("A_2_2", "x"), ("A_3", "last")]
    same = spark.createDataFrame([("f", "# A\n1\n# A\n2"), ("f", "# A\n3"), ("f", "# A\n3"), ("g", None), ("g", "no heading")], "path string, md string")
    assert sorted((r.page_key, r.body) for r in md.pages(same).collect()) == [("A", "1"), ("A", "3"), ("A", "3"), ("A_2", "2")]  # rows of one path apart


def test_news(spark):
    body = "## 2026 / 3 / 02\n**[Title one](http://u)**\ntext\n----\nplain block\n---\n\n---\n" + "（無法擷取內文）"
    page = spark.createDataFrame([("p", body)], "path string, body string")
    rows = md.news(page).orderBy("seq")
    assert [(r.date, r.title, r.url) for r in rows.collect()] == [("2026 / 3 / 02", "Title one", "http://u"), ("", md.NEWS_TITLE, ""), ("", md.NEWS_TITLE, "")]
    assert md.without_banners(rows).count() == 2


def test_faq_and_grades(spark):
    page = spark.createDataFrame([("intro\n### Q one?\nanswer\nmore\n### Q two?\n",)], "body string")
    assert [(r.title, r.body) for r in md.faqs(page).orderBy("seq").collect()] == [("Q one?", "answer\nmore"), ("Q two?", "")]
    table = "| 學年度 | 賽事名稱 | x | y | z |\n|---|---|---|---|---|\n| 1 | 2 | 3 | 4 |\n| 112 | Games | Run | 1 | Ann | extra |\n| a---b | 2 | 3 | 4 | 5 |\nnot a row"
    rows = md.grades(spark.createDataFrame([(table,)], "body string")).collect()
    assert [(r.title, r.type) for r in rows] == [("成績紀錄：Ann Games", "grade")]
    assert rows[0].text == "【競賽成績紀錄】學年度：112，賽事名稱：Games，競賽項目：Run，名次：1，參賽學生/隊伍：Ann"


def test_regulations(spark):
    text = "## 📄 Form.doc\n文件類型：表單\n來源網址：https://u/x\n原始格式：doc\n\n### Page 1\nhello\n### Page 2\n\n---\nno header\n---\n## 📄 Rule\n文件類型：法規\n\n---\n## 📄 Plain\nbody only\n----\nsame section"
    rows = md.regulations_and_forms(files(spark, text)).orderBy("section_no", "page_seq").collect()
    assert [(r.title, r.page, r.type, r.category, r.url, r.ext) for r in rows] == [
        ("Form.doc", "Page 1", "form", "表單", "https://u/x", "doc"), ("Rule", "Page 1", "regulation", "法規", "", ""), ("Plain", md.OVERVIEW, "form", md.UNKNOWN, "", ""),
    ]
    assert rows[1].chunk.startswith("Rule\n文件類型：法規")
    page = spark.createDataFrame([("## A.pdf\n### Page 1\nx\n## B\nwhole\n## C\n",)], "body string")
    chunks = md.regulation_pages(page)
    meta = spark.createDataFrame([("A", "u", "表單", "form", "d")], "title_norm string, url string, category string, type string, date string")
    joined = {r.title: (r.page, r.url, r.type) for r in metadata.by_title(chunks, meta).collect()}
    assert joined == {"A.pdf": ("Page 1", "u", "form"), "B": (md.OVERVIEW, "", "regulation")}
    assert [r.title for r in metadata.unmatched(chunks.withColumn("title_norm", F.col("title")), meta, "title_norm").orderBy("title").collect()] == ["A.pdf", "B"]


def test_corrections_and_files(spark, tmp_path):
    text = "## 修正紀錄：1\n- **所屬處室**：GE（x)\n\nother\n\n## 修正紀錄：2\n\n## 修正紀錄：3\n- **所屬處室**：zz"
    assert [r.dept for r in md.corrections(files(spark, text)).orderBy("seq").collect()] == ["ge", "ope", "ope"]
    path = tmp_path / "a.md"
    path.write_text("﻿# T\nx", encoding="utf-8")
    rows = md.read_files(spark, [str(path), str(tmp_path / "missing.md")])
    assert rows.first().md == "# T\nx" and md.read_files(spark, [str(tmp_path / "none")]).count() == 0


def test_chunking(spark):
    docs = spark.createDataFrame([(1, "x" * 799), (2, "y " * 400), (3, ("word " * 30 + "\n\n") * 20), (4, None), (5, "")], "doc_id long, text string")
    rows = chunking.chunks(docs).collect()
    assert [r.chunk for r in rows if r.doc_id == 1] == ["x" * 799]
    long = [r.chunk for r in sorted(rows, key=lambda r: r.chunk_id) if r.doc_id == 3]
    assert len(long) > 1 and all(len(c) <= 800 for c in long)
    assert all(any(a.endswith(b[:n]) for n in range(20, 151)) for a, b in zip(long, long[1:]))  # overlap by whole pieces
    assert chunking.split_recursively("z" * 2000) == ["z" * 2000]  # no separator
    windows = spark.createDataFrame([("ab" * 5,), ("",), (None,)], "t string").select(chunking.windows(F.col("t"), 4).alias("w"))
    assert [r.w for r in windows.collect()] == [["abab", "abab", "ab"], [], []]


def test_events_and_config(spark, tmp_path):
    lines = [{"event": "answer", "message_id": "a", "dept": "ge", "latency_s": 1.5}, {"event": "answer"}, {"event": "feedback", "rating": "up"}]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join([*map(json.dumps, lines), "", "{broken"]), encoding="utf-8")
    answers, feedback, corrupt = tables.events(spark, str(path))
    assert (answers.count(), feedback.count(), corrupt.count()) == (1, 1, 1)
    assert tables.config("A=1=2\n#B=3\nno", {"A": "0", "C": "9"}, comments=True) == {"A": "1=2", "C": "9"}
    questions = tmp_path / "q.json"
    questions.write_text(json.dumps([{"id": "1", "question": "x"}, {"id": "1", "question": "y"}]))
    assert [r.question for r in tables.json_array(spark, str(questions), "id string, question string").collect()] == ["y"]
    assert tables.json_array(spark, str(tmp_path / "none.json"), "id string").count() == 0


def test_events_follow_names_and_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"event": "feedback", "message_id": "m", "rating": "up"}) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"event": "feedback", "message_id": "m", "rating": r}) for r in ["up"] * 50 + ["down"]))
    _, feedback, _ = tables.events(spark, str(tmp_path))
    rows = feedback.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(52)) and rows[-1].rating == "down"


def workbook(path):
    import zipfile

    rows = [["title", "tags", "file_url"], ["A.pdf", "x,表單", "http://f"], ["B & C", "", ""]]
    texts = sorted({c for r in rows for c in r if c})
    escape = lambda s: s.replace("&", "&amp;")
    cell = lambda r, c, v: f'<c r="{"ABC"[c]}{r + 1}" t="s"><v>{texts.index(v)}</v></c>' if v else ""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="other" r:id="r1"/><sheet name="ge" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><r><t>{escape(t[:1])}</t></r><r><t>{escape(t[1:])}</t></r></si>" for t in texts) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c t="inlineStr"><is><t>n</t></is></c><c><v>5</v></c></row></sheetData></worksheet>')
        book.writestr("xl/worksheets/sheet2.xml", f"<worksheet {space}><sheetData>" + "".join(f"<row>{''.join(cell(r, c, v) for c, v in enumerate(line))}</row>" for r, line in enumerate(rows)) + "</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    from kelpline.sources import xlsx

    workbook(tmp_path / "w.xlsx")
    cells = tables.workbook(spark, str(tmp_path / "w.xlsx"), "ge")
    assert [(r.row_no, r.cells) for r in cells.orderBy("row_no").collect()] == [(0, {"title": "A.pdf", "tags": "x,表單", "file_url": "http://f"}), (1, {"title": "B & C"})]
    assert {tuple(r) for r in tables.regulation_metadata(cells).collect()} == {("A", "http://f", "表單", "form", ""), ("B&C", "", "法規", "regulation", "")}
    assert tables.workbook(spark, str(tmp_path / "w.xlsx"), "none").count() == 0
    assert list(xlsx.sheet_rows((tmp_path / "w.xlsx").read_bytes())) == [["n", "5"]] and list(xlsx.sheet_rows(b"no zip")) == []


def test_workbook_dates_and_broken_cells(spark, tmp_path):
    import zipfile

    from kelpline.sources import xlsx

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = [
        '<c t="inlineStr"><is><t>h</t></is></c>', '<c s="1"><v>45321</v></c>', '<c s="2"><v>45321.75</v></c>', '<c s="3"><v>45321</v></c>', '<c s="0"><v>45321</v></c>', '<c t="s"></c>', '<c t="s"><v>99</v></c>',
        '<c t="b"><v>1</v></c>', '<c s="1"><v>soon</v></c>', '<c t="d"><v>2024-01-30T00:00:00</v></c>', '<c s="1"><v>1e99</v></c>', '<c s="77"><v>2</v></c>', '<c r="?"><v>7</v></c>',
    ]
    path = tmp_path / "d.xlsx"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet {space}><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy&quot;y&quot;"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;[Red]\\d"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData><row>{''.join(cells)}</row></sheetData></worksheet>")
    assert list(xlsx.sheet_rows(path.read_bytes())) == [["h", "2024-01-30 00:00:00", "2024-01-30 18:00:00", "45321", "45321", "", "", "True", "", "2024-01-30 00:00:00", "", "2", "7"]]
    assert tables.workbook(spark, str(tmp_path / "missing.xlsx")).count() == 0


def test_events_with_fields_of_other_types(spark, tmp_path):
    lines = [
        '{"event":"answer","message_id":"m1","latency_s":"1.5","sources":"x"}', '{"event":"feedback","message_id":"m1","rating":"up","reasons":"other"}', '{"event":"answer","message_id":7,"latency_s":"fast","tools":["a","b"]}',
        '{"event":"feedback","message_id":null,"rating":true,"reasons":["other"]}', '{"event":"answer","message_id":"","latency_s":2}', '{"event":"answer","message_id":"m2","latency_s":2,"sources":[{"title":"t","url":"u"}]}', "not json", "[1]", '{"event": "answer"',
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    answers, voted, corrupt = tables.events(spark, str(tmp_path / "log.jsonl"))
    assert [(r.message_id, r.latency_s, r.sources, r.tools) for r in answers.orderBy("seq").collect()] == [("m1", 1.5, None, None), ("7", None, None, ["a", "b"]), ("m2", 2.0, [("t", "u")], None)]
    assert [(r.message_id, r.rating, r.reasons) for r in voted.orderBy("seq").collect()] == [("m1", "up", None), (None, "true", ["other"])]
    assert [r.seq for r in corrupt.orderBy("seq").collect()] == [6, 7, 8]


def test_many_sections(spark):
    count = 1_000_010
    docs = spark.range(1).select(F.lit("p").alias("path"), F.concat_ws("\n", F.array_repeat(F.lit("## t"), count)).alias("md"))
    assert docs.select(F.size(md._sections(F.col("md"), "##")).alias("n")).first().n == count


def test_passages(spark):
    items = spark.createDataFrame([("公告內容\n- [link](u)\n" + "text " * 60,), ("short",)], "raw string")
    got = md.passages(items, 200, 250, "公告內容").collect()
    assert len(got) == 1 and len(got[0].passage) == 250 and "link" not in got[0].passage
    title = "某校課程實施辦法"
    rows = md.regulation_passages(files(spark, f"## {title}\nearly\n# 相關法規\n## {title}\n### Page 1\n" + "rule " * 50 + "\n## next\nx", "none"), ["某校抵免辦法", title], "某校").collect()
    assert len(rows) == 1 and rows[0].label == "課程實施辦法" and rows[0].passage.startswith(f"## {title}\nrule") and "next" not in rows[0].passage
    lines = md.regulation_lines(files(spark, "lost\n## A\n a1 \n\na2\n### P1\n### P2\nb\n## B\n")).collect()
    assert {(r.title, r.page, r.text) for r in lines} == {("A", md.OVERVIEW, "a1\na2"), ("A", "P2", "b")}
    pairs = md.faq_pairs(files(spark, "### 抵免Q1 How so?\nAn answer that is long enough to stay here\n### no mark\nx\n### 抵免Q2 Why?\nshort"), [])
    assert [(r.label, r.question) for r in pairs.collect()] == [("抵免Q1", "How so?")]


def test_corpus(spark):
    from kelpline.sources import corpus

    main = files(spark, "# 最新消息\nnews\n# 常見問題\n### Q?\nA\n# 競賽成績\n| 1 | G | R | 1 | Ann |\n# P\nx")
    built = corpus.build(spark, main, None, files(spark, "## 修正紀錄：1\n- **所屬處室**：LC（x）"))
    assert [(r.doc_id, r.type, r.dept) for r in built.orderBy("doc_id").collect()] == [(0, "news", "ope"), (1, "faq", "ope"), (2, "grade", "ope"), (3, "page", "ope"), (4, "correction", "lc")]
    assert corpus.build(spark, main, compat=True).count() == 6
    assert corpus.build(spark).count() == 0
    rules = corpus.build(spark, regulation_files={"oaa": files(spark, "## T.pdf\n### Page 1\nrule")}, meta={"oaa": spark.createDataFrame([("T", "u", "表單", "form", "d")], "title_norm string, url string, category string, type string, date string")})
    assert [(r.dept, r.type, r.url, r.source, r.text) for r in rules.collect()] == [("oaa", "form", "u", "regulations", "rule")]


def test_summaries_and_paths(spark, tmp_path):
    old = spark.createDataFrame([("r1", 0.5)], "run string, a double")
    both = sinks.append_summary(old, spark.createDataFrame([("r2", 1.0)], "run string, b double"))
    assert both.columns == ["run", "a", "b"] and both.count() == 2 and sinks.append_summary(None, old).count() == 1
    sinks.write_metric(old, str(tmp_path / "m"))
    part = next(p for p in (tmp_path / "m").iterdir() if p.name.startswith("part"))
    assert part.read_bytes().startswith("\ufeff".encode()) and sinks.read_metric(spark, str(tmp_path / "m")).columns == ["run", "a"]
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "f").write_text("x")
    assert tables.resolve("f", [str(tmp_path / "one"), str(tmp_path / "two")]) == str(tmp_path / "two" / "f") and tables.resolve("g", ["/a", "/b"]) == "/a/g"
    rows, seen = spark.range(25).select("id"), []

    def summarise(done):
        seen.append(done.count())
        return done.agg(F.count("*").alias("n"))

    for _ in range(2):
        sinks.write_in_steps(rows, summarise, "id", str(tmp_path / "steps"))
    assert seen == [10, 20, 25] and spark.read.json(str(tmp_path / "steps/summary")).first().n == 25


def test_metadata_rows(spark):
    cells = spark.createDataFrame([(0, {"title": "A.pdf", "source_page": "p"}), (1, {"title": "A", "tags": "x,表單", "file_url": "f"}), (2, {"title": " "})], "row_no long, cells map<string,string>")
    assert [tuple(r) for r in tables.regulation_metadata(cells).collect()] == [("A", "f", "表單", "form", "")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("x", "", [], 0)], "a string, b string, c array<string>, d int")
    assert json.loads(sinks.event_line(rows, "answer").first().value) == {"event": "answer", "severity": "INFO", "a": "x", "c": [], "d": 0}
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for mark in ("one", "one", "two"):
        assert sinks.load_or_build(spark, str(tmp_path / "cache"), mark, build).count() == 3
    assert len(built) == 2
    sinks.append_csv(rows.drop("c"), str(tmp_path / "csv"))
    sinks.append_csv(rows.drop("c"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_dense_ids_and_fingerprint(spark):
    rows = spark.range(1000).select(F.hash("id").alias("h"), "id").repartition(7)
    got = metadata.dense_ids(rows, ["h", "id"]).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(1000)) and got == sorted(got, key=lambda r: (r.h, r.id))
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", None)], "source string, text string")
    same = metadata.fingerprint(docs.orderBy(F.desc("text")), "source").first()[0]
    assert metadata.fingerprint(docs, "source").first()[0] == same
    assert metadata.fingerprint(docs.limit(2), "source").first()[0] != same


def test_dense_ids_of_a_join_are_parted_by_bytes(spark, monkeypatch):
    few = lambda name: spark.range(1_000_000).where("id < 3").withColumnRenamed("id", name)
    rows, asked = few("a").crossJoin(few("b")), []  # nine rows, which the planner takes for 64 TB
    real = type(rows).repartitionByRange
    monkeypatch.setattr(type(rows), "repartitionByRange", lambda self, n, *cols: (asked.append(n), real(self, min(n, 100), *cols))[1])
    got = metadata.dense_ids(rows, ["a", "b"]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.a, r.b) for r in got] == [(3 * a + b, a, b) for a in range(3) for b in range(3)]
    assert max(asked) <= 4  # the session's partitions
