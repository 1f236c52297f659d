from pyspark.sql import functions as F

from kelpline.operators import evaluation, feedback, models, state


def test_validation(spark):
    rows = spark.createDataFrame(
        [(" UP ", "i" * 70, ["other", "bad", "other", "outdated"], "c" * 600), ("maybe", "x", None, None), ("down", " ", None, None), ("down", "y", None, None)],
        "rating string, message_id string, reasons array<string>, comment string",
    )
    good = feedback.valid_feedback(rows).orderBy("message_id").collect()
    assert [(r.rating, len(r.message_id), r.reasons, len(r.comment)) for r in good] == [("up", 64, ["other", "outdated"], 500), ("down", 1, [], 0)]


def test_last_write_wins_and_rates(spark):
    rows = spark.createDataFrame([("a", 1, "up"), ("b", 2, "maybe"), ("a", 3, "down"), (None, 4, "up"), (None, 5, "down")], "message_id string, seq long, rating string")
    last = feedback.latest(rows, "message_id", "seq")
    assert {(r.message_id, r.rating, r.first_seen) for r in last.collect()} == {("a", "down", 1), ("b", "maybe", 2), (None, "down", 4)}
    assert feedback.rates(last).first()[:3] == (0, 2, 2)
    answers = spark.createDataFrame([("a", "ge"), ("b", "ge")], "message_id string, dept string")
    assert feedback.rates_by(last, answers, "dept").first()[:4] == ("ge", 0, 2, 2)  # here maybe counts as down
    assert feedback.orphans(last.na.fill("z"), answers).count() == 1
    assert feedback.rates(last.limit(0)).first().satisfaction is None


def test_nearest_rank(spark):
    for n in (1, 2, 20, 21):
        values = sorted((i * 7919) % 101 for i in range(n))
        rows = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
        got = feedback.nearest_rank(rows, "v", ["g"]).first()
        assert (got.p50, got.p95, got.max) == (values[n // 2], values[max(0, int(0.95 * n) - 1)], values[-1])
        assert feedback.nearest_rank(rows, "v", []).first() == (n, got.p50, got.p95, got.max)
    nulls = spark.createDataFrame([(None, 1.0), (None, 3.0), ("g", None)], "g string, v double")
    assert [tuple(r) for r in feedback.nearest_rank(nulls, "v", ["g"]).collect()] == [(None, 2, 3.0, 1.0, 3.0)]
    assert feedback.nearest_rank(nulls.limit(0), "v", []).count() == 0


def test_reasons(spark):
    rows = spark.createDataFrame([(1, ["other", "outdated"]), (2, ["outdated"]), (3, [])], "first_seen long, reasons array<string>")
    assert [(r.reason, r.n) for r in feedback.reason_counts(rows).collect()] == [("outdated", 2), ("other", 1)]


def admitted(times, limit=15, window=60):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if t - k < window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def test_admission(spark):
    for times in ([*range(16), 60], [0] * 20 + [59, 60, 61], list(range(0, 300, 3))):
        rows = spark.createDataFrame([(1, t, i) for i, t in enumerate(times)], "ip long, at long, seq long")
        got = [r.admitted for r in state.admit(rows, "ip", "at", "seq", 15, 60).orderBy("seq").collect()]
        assert got == admitted(times)


def test_history(spark):
    rows = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", None if t == 5 else f"m{t}" * 50) for t in range(10)], "conv_id long, turn long, role string, text string")
    assert state.history(rows).count() == 7
    assert state.last_user_turn(rows).first().text == ("m9" * 50)[:80]


def test_evaluation(spark):
    rows = spark.createDataFrame([("ge", "CORRECT", True), ("ge", "PARTIAL", None), ("lc", "JUDGE_ERROR", False), ("other", "WRONG", None)], "dept string, verdict string, tool_hit boolean")
    got = {(r.dept, r.overall): (r.n, r.strict, r.weighted, r.tool_accuracy) for r in evaluation.verdict_rollup(rows, ("ge", "lc")).collect()}
    assert got[None, 1] == (4, 0.25, 0.375, 0.5) and got["ge", 0] == (2, 0.5, 0.75, 1.0) and ("other", 0) not in got
    frame = spark.createDataFrame([("a b",), ("",)], "x string")
    assert [r.t for r in frame.select(evaluation.infer_tool(F.col("x"), {"p": ("b", "z"), "q": ("a",)}, "none").alias("t")).collect()] == ["p", "none"]
    assert frame.select(evaluation.metric_mean(F.lit(float("nan"))).alias("m")).first().m == 0.0
    sub = spark.createDataFrame([("WRONG", "查無"), ("WRONG", "x"), ("CORRECT", "x")], "v string, a string").select(evaluation.wrong_subtype(F.col("v"), F.col("a"), ["查無"]).alias("s"))
    assert [r.s for r in sub.collect()] == ["no_data", "wrong_fact", "n/a"]
    ids = evaluation.assign_ids(spark.createDataFrame([("q2",), ("q1",)], "q string"), spark.createDataFrame([("V4007",), ("other",)], "id string"), [F.col("q")])
    assert [(r.q, r.id) for r in ids.orderBy("id").collect()] == [("q1", "V4008"), ("q2", "V4009")]


def test_evaluation_filters(spark):
    rows = spark.createDataFrame([("a", ["c"], "g"), ("", ["c"], "g"), ("a", [], "g"), ("a", ["c"], None), ("a", None, "g")], "answer string, contexts array<string>, ground_truth string")
    assert evaluation.scorable(rows).count() == 1
    told = spark.createDataFrame([("short",), ("long enough to be no vague answer",), ("long enough but See Website for more",)], "a string")
    assert [r.v for r in told.select(evaluation.vague(F.col("a"), ["see website"]).alias("v")).collect()] == [True, False, True]


def test_model_defaults(spark):
    frame = spark.createDataFrame([("a\n \n b ", "q"), (None, "q")], "r string, q string")
    got = frame.select(models.rewrites_of(F.col("r"), F.col("q")), models.passage_of(F.col("r"), F.col("q")), models.scores_of(F.lit("[1, 2.5]")), models.scores_of(F.lit("none")), models.injected(F.col("r")), models.transcript(F.col("r"))).collect()
    assert got[0][0] == ["a", "b"] and got[1][:2] == (["q"], "q") and got[0][2] == [1.0, 2.5] and not got[0][3] and not got[1][4] and got[1][5] == models.NO_TRANSCRIPT
    judged = spark.createDataFrame([("", "t", "1"), ("很抱歉", "t", "1"), ("a", "t", None), ("a", "t", "7"), ("a", "t", "about 0.33335")], "a string, t string, r string")
    assert [r.c for r in judged.select(models.completeness(F.col("a"), F.col("t"), F.col("r")).alias("c")).collect()] == [0.0, 0.1, 0.5, 1.0, 0.3334]
    assert frame.select(models.clamp(F.lit(-1.0)).alias("a"), models.clamp(F.lit(float("nan"))).alias("b")).first() == (0.0, 0.5)
    replies = spark.createDataFrame([("x", 'text [{"question": "Q", "ground_truth": "a truth that is long enough"}, {"question": "", "ground_truth": "y"}] end'), ("y", "none")], "label string, reply string")
    assert [tuple(r) for r in models.generated_pairs(replies, ["vague"]).collect()] == [("x", "Q", "a truth that is long enough")]
    assert models.generated_pairs(replies.withColumn("asked", F.lit("Q")), [], question="asked").count() == 0
    said = spark.createDataFrame([("", None), ("- x", "s")], "listing string, r string").select(models.fallback_answer(F.col("listing")).alias("f"), models.spoken_summary(F.col("r"), F.lit("# *A* https://u b")).alias("s")).collect()
    assert said[0].f == models.FALLBACK_NONE and "- x" in said[1].f and (said[0].s, said[1].s) == ("A  b", "s")
    calls = spark.createDataFrame([(i,) for i in range(6)], "round int")
    assert models.agent_rounds(calls).count() == 3
    parsed = spark.createDataFrame([('{"year": 3}',), ("broken",)], "a string").select(models.tool_arguments(F.col("a"), "year int").alias("p")).collect()
    assert [r.p.year for r in parsed] == [3, None]


def test_model_boundary(spark):
    frame = spark.createDataFrame([("GE please", "partial!", "Yes"), (None, "?", None)], "r string, j string, y string")
    got = frame.select(models.route(F.col("r")).alias("r"), models.verdict(F.col("j")).alias("j"), models.yes(F.col("y")).alias("y")).collect()
    assert [tuple(g) for g in got] == [("ge", "PARTIAL", True), ("ope", "JUDGE_ERROR", False)]
    replies = spark.createDataFrame([("OPE, not GE", "ope"), ("LC or GE", "lc"), ("ge", "ge"), ("INJECT other", "inject")], "r string, want string")
    assert all(r.got == r.want for r in replies.select("want", models.route(F.col("r")).alias("got")).collect())
    pick = spark.range(1).select(*[models.ordinal_pick(F.array(F.lit("a"), F.lit("b")), F.lit(i)).alias(f"p{i}") for i in (0, 1, 3)]).first()
    assert tuple(pick) == ("b", "a", "b")
