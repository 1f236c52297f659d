from pyspark.sql import functions as F

from kelpline.functions import text as tx


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first().y


def test_tokens(spark):
    assert one(spark, "體育館場 a ABC_1 é", tx.index_tokens(F.col("x"))) == ["體育", "育館", "館場", "a", "abc_1"]
    assert one(spark, "體 Ab", tx.index_tokens(F.col("x"))) == ["體", "ab"]
    assert one(spark, "體育館場 ABC_1", tx.raw_tokens(F.col("x"))) == ["體育館場", "ABC_1"]
    assert one(spark, None, tx.index_tokens(F.col("x"))) == []


def test_title_keys(spark):
    assert one(spark, " A b.PDF", tx.title_key(F.col("x"))) == "Ab"
    assert one(spark, "借　用.x.docx.pdf", tx.title_key(F.col("x"))) == "借用.x.docx"
    assert one(spark, "1.、2 借用表.XLSX", tx.citation_key(F.col("x"))) == "借用表"


def test_years(spark):
    cases = {"113年": ("2024", "2024"), "113學年度": ("2024度", "2024度"), "15年": ("1926", "1926"), "2023年": ("21934", "2023年"), "民國 99 年底": ("2010底", "2010底"), "": ("", "")}
    for text, (compat, strict) in cases.items():
        assert one(spark, text, tx.rewrite_years(F.col("x"), compat=True)) == compat
        assert one(spark, text, tx.rewrite_years(F.col("x"))) == strict
    assert one(spark, "112", tx.both_years(F.col("x"))) == one(spark, "2023", tx.both_years(F.col("x"))) == ("112", "2023")
    assert one(spark, "112x", tx.both_years(F.col("x"))) == (None, None)
    assert one(spark, "2024-07-31", tx.academic_year(F.to_date("x"))) == 112
    assert one(spark, "2024-08-01", tx.academic_year(F.to_date("x"))) == 113


def test_markup_and_answers(spark):
    assert one(spark, " <b>x</b> **bold** [t](http://u) ", tx.clean_markup(F.col("x"))) == "x bold t"
    assert one(spark, "%E9%AB%94", tx.decode_url(F.col("x"))) == "體"
    assert one(spark, "50%", tx.decode_url(F.col("x"))) == "50%"
    assert one(spark, "a+b 50% %E9%AB%94 %zz", tx.decode_url(F.col("x"))) == "a+b 50% 體 %zz"
    assert one(spark, "%E9%AB", tx.decode_url(F.col("x"))) == "\ufffd"
    assert str(one(spark, "2024 / 3 / 05", tx.to_day(F.col("x")))) == "2024-03-05" and one(spark, "", tx.to_day(F.col("x"))) is None
    assert len(one(spark, "x", tx.message_id())) == 32
    assert one(spark, " 查無相關資訊。", tx.soften(F.col("x"))) == tx.EMPTY_REPLY
    assert one(spark, None, tx.soften(F.col("x"))) == tx.BLANK_REPLY
    assert one(spark, "fine", tx.soften(F.col("x"))) == "fine"
    assert one(spark, "aaa", tx.occurrences(F.col("x"), F.lit("aa"))) == 1
    assert one(spark, "a b a", tx.total_occurrences(F.col("x"), ["a", "a"])) == 4
    assert one(spark, "Cannot Answer.", tx.mentions_any(F.col("x"), ["cannot answer."])) is True
    assert one(spark, "x", tx.bar(F.lit(1), F.lit(2))) == "█" * 14 + "░" * 14


def test_batches_of_long_texts_stay_small(spark):
    import pyarrow as pa

    from kelpline.session import prepare

    prepare(spark)
    rows = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('x', 20000) AS text")
    sizes = rows.mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) > 400 * 20000 and max(r.n for r in sizes) < 2 << 20
