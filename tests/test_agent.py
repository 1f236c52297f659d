"""The agent loop over many conversations: equal to one by one, with calls of every tool and the failure path."""

import pytest
from pyspark.sql import functions as F

from kelpline.operators import agent
from kelpline.operators.models import FALLBACK_HEAD
from kelpline.plans import tools

CALLS = {
    1: [[("c", "find_forms", '{"keyword": "alpha"}'), ("", "get_latest_news", '{"keyword": "beta"}')], [("d", "get_schedule", '{"year": "2023"}')], "answer one"],
    2: ["at once"],
    3: [[("x", "nosuchtool", "{}"), ("y", "get_competition_records", '{"name": "Ann"}')], None],
    4: [[("a", "search_regulations_and_general", "broken json")]] * 9,
    5: [None],
    6: [[("r", "record_correction", '{"original_query": "q", "correction_info": "i"}'), ("n", "get_latest_news", None), ("s", "get_schedule", '{"year": 1999}')], "noted"],
}


class Scripted:
    """Replies by script: calls, an answer, or a failure (None)."""

    def __init__(self, spark):
        rows = []
        for conv, script in CALLS.items():
            for number, step in enumerate(script):
                calls = [{"id": i, "name": n, "arguments": a} for i, n, a in step] if isinstance(step, list) else []
                rows.append((conv, number, step if isinstance(step, str) else None, calls, step is None))
        self.replies = spark.createDataFrame(rows, f"conv_id long, round int, content string, calls {agent.CALL}, failed boolean").cache()
        self.offered = []

    def reply(self, open_, tools):
        self.offered.append(tools)
        return open_.select("conv_id", "round").join(self.replies, ["conv_id", "round"])


@pytest.fixture
def base(spark, tmp_path):
    rows = [
        (1, "ge", "news", "", "Alpha day", "u1", "2024 / 01 / 02", "", "", "alpha beta"), (2, "lc", "news", "", "Other", "u2", "2024 / 03 / 02", "", "", "beta beta"), (4, "ge", "form", "表單", "Alpha form", "f1", "", "pdf", "", "use alpha"),
        (8, "ge", "page", "", "體育課表 2023", "p", "2023 / 09 / 01", "", "", "課程 [k](http://k)"), (9, "ge", "page", "", "課表", "p", "2024 / 09 / 01", "", "", "課程表"), (10, "ge", "grade", "", "g", "", "", "", "", "Ann 2024 won"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, dept string, type string, category string, title string, url string, date string, ext string, page string, text string").withColumn("source", F.lit("x")).cache()
    return tools.Knowledge(docs, None, str(tmp_path / "corrections"))


def talked(rows):
    return {r.conv_id: (r.answer, r.rounds, r.tools, [(m.role, m.name, m.call_id, m.content) for m in r.messages], r.failed) for r in rows.collect()}


def test_many_conversations_equal_one_by_one(spark, base):
    asked = spark.createDataFrame([(i, "alpha beta", "ge" if i == 4 else None) for i in CALLS], "conv_id long, query string, dept string")
    model = Scripted(spark)
    together = talked(agent.run(base, model, asked))
    assert model.offered == [True, True, True, False] and set(together) == set(CALLS)
    answer, rounds, called, messages, failed = together[1]
    assert (answer, rounds, called, failed) == ("answer one", 3, ["find_forms", "get_latest_news", "get_schedule"], False)
    assert [m[:3] for m in messages] == [("assistant", None, None), ("tool", "find_forms", "c"), ("tool", "get_latest_news", "call_0_1"), ("assistant", None, None), ("tool", "get_schedule", "d")]
    assert messages[1][3] == agent.FORMS_HEAD + "- [Alpha form](f1)（pdf）" and messages[2][3].index("Other") < messages[2][3].index("Alpha day") and messages[4][3].startswith("- **體育課表 2023**")
    assert together[2] == ("at once", 1, [], [], False)
    assert together[3][0].startswith(FALLBACK_HEAD) and together[3][1:3] == (2, ["nosuchtool", "get_competition_records"]) and together[3][4]
    assert together[3][3][1][3] == agent.UNKNOWN_TOOL and together[3][3][2][3] == "為您找到 1 筆成績紀錄：\nAnn 2024 won"
    assert together[4][0] == "" and together[4][1] == agent.ROUNDS and together[4][2] == ["search_regulations_and_general"] * 3 and "use alpha" in together[4][3][1][3] and "beta beta" not in together[4][3][1][3]
    assert together[5][4] and together[5][1] == 1
    assert together[6][3][1][3] == agent.RECORDED and "（找不到 1999 年的課表" in together[6][3][3][3] and together[6][3][2][3].count("【標題】") == 2
    for conv in (1, 3):
        assert talked(agent.run(base, model, asked.where(F.col("conv_id") == conv)))[conv] == together[conv]


def test_no_conversations(spark, base):
    none = spark.createDataFrame([], "conv_id long, query string, dept string")
    assert agent.run(base, Scripted(spark), none).count() == 0
