import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kelpline.operators import feedback as batch
from kelpline.operators import state
from kelpline.streaming import feedback, joined, limiter

START = datetime(2024, 1, 1)


def played(spark, folder, schema, files, make, name):
    """What a stream gives over *files*, each a micro-batch of its own; and the query's progress."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "in" / f"f={i}"))
    places = sorted((folder / "in").iterdir(), key=lambda p: int(p.name[2:]))
    progress = []
    for i, place in enumerate(places):
        own = folder / "seen" / f"p{i}"
        own.parent.mkdir(exist_ok=True)
        place.rename(own)
        stream = spark.readStream.schema(schema).parquet(str(folder / "seen" / "*"))
        query = make(stream).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        progress += [p for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(str(folder / "out")), progress


def test_admission_stream_equals_batch_and_forgets(spark, tmp_path):
    second = 1_000_000
    rows = [(w, (1000 + t * 10 + w) * second, w * 1000 + t) for w in range(3) for t in range(60)]
    rows.sort(key=lambda r: r[1])
    files = [rows[i : i + 60] for i in range(0, 180, 60)]
    files += [[(9, 10_000 * second, 9999)], [(9, 20_000 * second, 9998)]]  # time goes on
    found, progress = played(spark, tmp_path, "who long, micros long, event_id long", files, lambda s: limiter.admit_stream(s, 3, 100 * second), "a")
    got = {(r.event_id, r.admitted) for r in found.collect()}
    everything = spark.createDataFrame(sum(files, []), "who long, micros long, event_id long")
    assert got == {(r.event_id, r.admitted) for r in state.admit(everything, "who", "micros", "event_id", 3, 100 * second).collect()}
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(sizes) > sizes[-1]  # idle keys are gone


def test_late_requests_never_break_a_window(spark, tmp_path):
    rng, second = random.Random(3), 1_000_000
    rows = [(i % 2, rng.randrange(300) * second, i) for i in range(120)]
    rows.sort(key=lambda r: r[1] + rng.randrange(40) * second)  # up to 40 s late
    files = [rows[i : i + 30] for i in range(0, 120, 30)]
    found, _ = played(spark, tmp_path, "who long, micros long, event_id long", files, lambda s: limiter.admit_stream(s, 2, 30 * second, "60 seconds"), "l")
    decided = {r.event_id: r.admitted for r in found.collect()}
    assert len(decided) == 120  # none is older than the watermark
    for who in (0, 1):
        times = sorted(t for w, t, i in rows if w == who and decided[i])
        assert all(times[i + 2] - times[i] >= 30 * second for i in range(len(times) - 2))
    kept: dict[int, list] = {0: [], 1: []}
    for own in files:  # the rule, request by request
        for w, t, i in sorted(own, key=lambda r: (r[1], r[2])):
            near = sorted([x for x in kept[w] if abs(x - t) < 30 * second] + [t])
            assert decided[i] == all(near[j + 2] - near[j] >= 30 * second for j in range(len(near) - 2))
            if decided[i]:
                kept[w].append(t)


@pytest.mark.parametrize("seed", range(3))
def test_admission_of_one_hot_key(spark, seed):
    rng = random.Random(seed)
    times, now = [], 0
    for _ in range(400):
        now += rng.choice([1, 2, 5, 40])
        times.append(now)
    rows = [("hot", t, i) for i, t in enumerate(times)] + [("b", 5, 1000), (None, 5, 1001), (None, 6, 1002), ("b", None, 1003)]
    frame = spark.createDataFrame(rows, "who string, micros long, event_id long").repartition(5)
    assert state.restarts(frame, "who", "micros", "event_id", 30).where("who = 'hot'").select("segment").distinct().count() == 1 + sum(b - a >= 30 for a, b in zip(times, times[1:]))
    want, held = {1000: True, 1001: True, 1002: True, 1003: True}, []
    for i, t in enumerate(times):
        held = [x for x in held if t - x < 30]
        want[i] = len(held) < 3
        held += [t] * want[i]
    got = state.admit(frame, "who", "micros", "event_id", 3, 30)
    assert {r.event_id: r.admitted for r in got.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else few rows go to one task
    used = got.where("who = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert used > 1  # one key, several tasks
    assert state.admit(frame.limit(0), "who", "micros", "event_id", 3, 30).count() == 0


def test_feedback_table_grows_by_what_comes(spark, tmp_path):
    rng, schema = random.Random(5), "message_id string, seq long, rating string"
    path, seen, sizes = str(tmp_path / "t"), [], []
    for n in range(11):
        rows = [(rng.choice([None, *map(str, range(40))]), n * 100 + i, rng.choice(["up", "down", None])) for i in range(rng.choice([0, 5, 12]))]
        frame = spark.createDataFrame(rows, schema)
        feedback.upsert(frame, n, path, fan=3)
        if n in (4, 8):
            feedback.upsert(frame, n, path, fan=3)  # a repeated batch
        seen += rows
        sizes.append(sum(p.stat().st_size for p in tmp_path.glob(f"t/level=0/batch={n}/*.parquet")))
        want = {tuple(r) for r in batch.latest(spark.createDataFrame(seen, schema), "message_id", "seq").select("message_id", "seq", "rating", "first_seen").collect()}
        got = [tuple(r) for r in feedback.current(spark, path, n, fan=3).select("message_id", "seq", "rating", "first_seen").collect()]
        assert len(got) == len(want) and set(got) == want
    assert feedback.live(10, 3) == [(2, 8), (0, 9), (0, 10)]
    assert max(sizes) < 40_000 and not list(tmp_path.glob("t/level=0/batch=2/*"))  # merged runs go


def test_feedback_stream_keeps_the_last(spark, tmp_path):
    schema = "message_id string, seq long, rating string"
    for rows in ([("a", 1, "up"), ("b", 2, "up")], [("a", 3, "down")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        feedback.keep_latest(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = {(r.message_id, r.rating, r.first_seen) for r in feedback.current(spark, str(tmp_path / "out"), 1).collect()}
    assert got == {("a", "down", 1), ("b", "up", 2)}


def test_answers_meet_feedback_like_in_batch(spark, tmp_path):
    rng = random.Random(9)
    events = []
    for i in range(160):
        kind = rng.choice(["answer", "feedback"])
        message = f"m{rng.randrange(25)}" if kind == "answer" else f"m{rng.randrange(15, 45)}"
        events.append((message, i, START + timedelta(seconds=rng.randrange(100)), kind, rng.choice(["up", "down"]) if kind == "feedback" else rng.choice(["ge", "lc"])))
    rng.shuffle(events)  # out of order within two minutes
    files = [events[i : i + 40] for i in range(0, 160, 40)] + [[("end", 1000, START + timedelta(hours=2), "answer", "x")], [("end2", 1001, START + timedelta(hours=3), "answer", "x")]]

    def meet(stream):
        kind = lambda k, what: stream.where(F.col("kind") == k).select("message_id", "seq", "at", F.col("what").alias(what))
        return joined.settle(kind("answer", "dept"), kind("feedback", "rating"), "10 minutes", 600_000)

    found, _ = played(spark, tmp_path, "message_id string, seq long, at timestamp, kind string, what string", files, meet, "j")
    got = [tuple(r) for r in found.where("message_id not like 'end%'").collect()]
    whole = spark.createDataFrame(events, "message_id string, seq long, at timestamp, kind string, what string")
    voted = batch.latest(whole.where("kind = 'feedback'").select("message_id", "seq", F.col("what").alias("rating")), "message_id", "seq")
    answers = batch.latest(whole.where("kind = 'answer'").select("message_id", "seq", F.col("what").alias("dept")), "message_id", "seq")
    want = voted.withColumnRenamed("seq", "feedback_seq").join(answers.select("message_id", "dept", F.col("seq").alias("answer_seq")), "message_id", "full").select("message_id", "rating", "feedback_seq", "first_seen", "dept", "answer_seq")
    assert sorted(got, key=str) == sorted(map(tuple, want.collect()), key=str)
    orphans = {r.message_id for r in batch.orphans(voted, answers).collect()}
    assert orphans and orphans == {m for m, rating, *_, answer in got if rating and answer is None}
