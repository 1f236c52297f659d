"""An index that follows its files: equal to one built anew, with work in proportion to what changed."""

import random

from pyspark.sql import functions as F

from kelpline.operators import inverted, refresh, retrieval


def documents(files):
    """Each paragraph of a file is a document; ids follow the paths."""
    lines = files.select("path", F.posexplode(F.split("content", "\n\n")).alias("no", "text"))
    number = F.regexp_extract("path", "[0-9]+", 0).cast("long")
    return lines.where(F.col("text") != "").select("path", (number * 1000 + F.col("no")).alias("doc_id"), "text", F.when(number % 2 == 0, "a").otherwise("b").alias("dept"))


def test_refresh_equals_rebuild(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefg", k=3)) for _ in range(60)]
    text = lambda: "\n\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 25))) for _ in range(rng.randrange(1, 6)))
    held = {f"f{i}.md": text() for i in range(30)}
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3))) for i in range(6)] + [(9, "brandnew")], "query_id long, query string")
    kept = refresh.Refreshed(spark, str(tmp_path / "index"), keep=["dept"], groups=16, cell_docs=4)

    def same(expected):
        files = spark.createDataFrame(list(held.items()), "path string, content string")
        told = kept.refresh(files, documents)
        assert expected(told), told
        whole = retrieval.build_index(documents(files), keep=["dept"], cell_docs=4)
        for among in (None,) if told["read"] == 1 else (F.col("dept") == "a",):
            rows = lambda index: sorted(map(tuple, inverted.search(index, asked, 5, among=among).collect()))  # noqa: E731, B023
            assert rows(kept.index()) == rows(whole)

    same(lambda t: t["read"] == t["groups"] > 8)
    held["f3.md"] = text() + "\n\nbrandnew brandnew"
    same(lambda t: t["read"] == 1)
    del held["f5.md"]
    held["f40.md"], held["f41.md"] = "longer " * 300, ""
    same(lambda t: 1 <= t["read"] <= 3)
    files = spark.createDataFrame(list(held.items()), "path string, content string")
    assert kept.refresh(files.repartition(3), documents)["read"] == 0  # nothing changed
    before = {p.name for p in (tmp_path / "index").iterdir()}
    assert before >= {"generation=0", "generation=1", "generation=2"}
