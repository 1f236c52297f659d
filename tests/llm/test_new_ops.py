"""Hard negatives, fingerprints and periodic runs against brute force, with edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import fingerprints, hard_negatives, query_defs, runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- hard negatives


def mined(rows, positives, negatives, every, least=30, most=90):
    """Brute force over (id, label, vector)."""
    fine = [r for r in rows if None not in r and not any(x is None or not math.isfinite(x) for x in r[2])]
    one = {}
    for i, label, v in fine:
        v = [math.floor(256 * x) for x in v]
        one[i] = min(one.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in one.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in one.items() if i != a)
        for minus, p, _ in [s for s in scored if s[2] == label][:positives]:
            window = [s for s in scored if s[2] != label and least * -minus <= 100 * -s[0] <= most * -minus]
            out += [(a, p, rank, i, -minus, -s) for rank, (s, i, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [4096, 37])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 7))
    rows = [(i, int(label := rng.integers(0, 4)), (centres[label] + rng.normal(size=7) * 0.7).tolist()) for i in range(400)]
    rows += [(1000 + i, 1, rows[3][2]) for i in range(60)] + [(2000 + i, 2, rows[3][2]) for i in range(60)]  # copies, ties
    rows += [(5, 1, rows[5][2]), (10, 9, rows[10][2]), rows[20]]  # ids repeated
    rows += [(None, 1, rows[0][2]), (3000, None, rows[0][2]), (3010, 1, None), (3020, 1, [1.0, float("nan")] * 3), (3030, 1, [None] + rows[0][2][1:]), (3040, 1, [float("inf")] * 7)]
    rows += [(3050, 1, [1.0, 2.0]), (3060, 2, [0.5] * 12), (3070, 3, []), (3080, 77, rows[1][2])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, v string").repartition(5)
    got = hard_negatives.mine(frame, F.col("id") % 10 == 0, positives=3, negatives=4, shard_rows=shard_rows)
    assert sorted(map(tuple, got.collect())) == mined(rows, 3, 4, 10)
    assert hard_negatives.mine(frame.limit(0), F.col("id") % 10 == 0).count() == 0


def test_bounds_hold_and_spare_most_rows():
    rng = np.random.default_rng(5)
    vectors = np.floor(256 * rng.normal(size=(2000, 16)) / 4).astype(np.int64)
    exact = vectors[:20] @ vectors.T
    for far in (1, 1 << 20):  # whole numbers beyond doubles
        lower, upper = hard_negatives.Approximation(*hard_negatives.approximate(vectors * far)).bounds(vectors[:20] * far)
        assert (lower <= exact * far**2).all() and (exact * far**2 <= upper).all()
        kth = hard_negatives._kth(lower, 5)
        assert (upper >= kth[:, None]).mean() < 0.01  # the share of rows that is scored exactly


# --- fingerprints


def plain_sketch(text, k=fingerprints.K):
    """The same fingerprint, element by element."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    if not text:
        return [0] * fingerprints.ENTRIES
    k, base = min(k, len(text)), fingerprints.textcore.BASE
    hashes, seen, elements = [], {}, []
    for i in range(len(text) - k + 1):
        hashes.append(mix((sum((ord(c) + 1) * pow(base, j, 1 << 64) for j, c in enumerate(text[i : i + k])) + k) & mask))
        number = seen[text[i : i + k]] = seen.get(text[i : i + k], -1) + 1
        elements.append((mix((hashes[i] + number * int(fingerprints.NEXT_OCCURRENCE)) & mask) if number else hashes[i]) >> 32)
    out = []
    for factor in fingerprints.FACTOR.tolist():
        least = sorted(range(len(elements)), key=lambda i: (elements[i] * factor & 0xFFFFFFFF, i))[: fingerprints.TUPLE]
        told = 0
        for i in sorted(least):  # in the order of the text
            told = mix((told + hashes[i]) & mask)
        out.append(told >> 32)
    return out


TEXTS = ["", "a", "seven c", "aaaaaaaaaaaaaaaaaaaa", "the quick brown fox jumps over the lazy dog " * 3, "日本語のテキスト🎉 és ünïcode", "\n\t ", "x" * 300 + "y" + "x" * 300]


def test_sketch_equals_plain_version():
    for text in TEXTS:
        assert fingerprints.sketch(text).tolist() == plain_sketch(text)


def test_sketch_tells_order():
    rng = random.Random(1)
    words = [f"w{rng.randrange(9999)}" for _ in range(400)]
    text, swapped = " ".join(words), " ".join(words[200:] + words[:200])
    changed = words.copy()
    changed[100] = "other"
    near = lambda a, b: fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(b))
    assert near(text, text) == 1 and near(text, " ".join(changed)) > 0.8
    assert 0.2 < near(text, swapped) < 0.8  # the same k-mers, about half of the pairs in the other order
    assert near(text, " ".join(f"w{rng.randrange(9999)}" for _ in range(400))) < 0.1


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_follow_the_order(spark, monkeypatch, parts):
    rows = [(i * 3 % 41, (TEXTS[i % len(TEXTS)] or "z") + str(i)) for i in range(30)] + [(50, None), (51, ""), (52, TEXTS[4]), (53, TEXTS[4]), (None, "no id")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, end string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = fingerprints.with_next(frame).collect()
        digests = {r.doc_id: r.edited for r in fingerprints.with_next(frame, digests=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, theirs = (np.array(plain_sketch(t)) for t in (text, edited, following))
        want[i] = (len(text), edited, "".join(f"{x:08x}" for x in own), "".join(f"{x:08x}" for x in changed), (own == changed).mean(), (own == theirs).mean())
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert digests == {i: hashlib.sha256(w[1].encode()).hexdigest() for i, w in want.items()}


def test_fingerprints_of_few_and_repeated_rows(spark):
    one = spark.createDataFrame([(1, "a single text")], "doc_id long, text string")
    row = fingerprints.with_next(one).first()
    assert row.near_next == 1 and row.edited == "a singl" + "a sing"
    assert fingerprints.with_next(one.limit(0)).count() == 0
    twice = fingerprints.with_next(one.union(one).union(spark.createDataFrame([(1, "other")], "doc_id long, text string")))
    assert sorted(r.n_chars for r in twice.collect()) == [5, 13, 13]


# --- periodic runs


def plain_runs(words, least_length=6, least_exponent=4):
    found = []
    for period in range(1, len(words) // least_exponent + 1):
        start = 0
        while start + period < len(words):
            end = start
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end - start + period >= max(least_length, least_exponent * period):
                found.append((start, end - start + period, period))
            start = max(end, start) + 1
    smallest = lambda r: not any(s <= r[0] and s + n >= r[0] + r[1] and q < r[2] for s, n, q in found)
    return sorted(filter(smallest, found))


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(4))
def test_periodic_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 6)):
            letters = rng.choice([1, 2, 3, 5])
            own = [rng.randint(1, letters) for _ in range(rng.choice([0, 1, 3, 20, 60]))]
            root = [rng.randint(1, 4) for _ in range(rng.randint(1, 6))]
            texts.append(own + (root * 9)[: rng.randint(0, 9 * len(root))] + [rng.randint(1, letters) for _ in range(rng.randint(0, 5))])
        bounds = np.cumsum([0, *map(len, texts)])
        got = runs.periodic_runs(np.array(sum(texts, []), np.int64), bounds, 6, 4)
        assert list(map(tuple, got.tolist())) == [(d, *r) for d, t in enumerate(texts) for r in plain_runs(t)]


def test_long_runs_and_next_smaller(monkeypatch):
    values = np.concatenate([np.arange(5000)[::-1] + 2, [1], np.arange(3000) + 2, [0]])
    want, stack = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            want[stack.pop()] = i
        stack.append(i)
    assert runs.next_smaller(values)[:-1].tolist() == want[:-1]
    text = [1, 2, 3] * 7000 + [9] + [4] * 20_000  # longer than a block of the table
    assert runs.periodic_runs(np.array(text), np.array([0, len(text)]), 6, 4).tolist() == [[0, 0, 21_000, 3], [0, 21_001, 20_000, 1]]


def test_find_runs(spark):
    texts = [None, "", " \t\n", "one", "no no no no no no", "x no no no no no y", "a b a b a b a b tail", "  a b\x0ba b\ra b\na b\ta  ", "é ü " * 5, "NO no " * 3 + "no no", "a a a a a a b b b b b b", "w" * 50_000 + " z" * 9]
    frame = spark.createDataFrame([(i, t, i, "k") for i, t in enumerate(texts)] + [(4, texts[4], 0, "k")], "doc_id long, text string, runs int, collapsed string").repartition(3)
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(frame).collect()]
    want = [(i, found := plain_runs(words := WORDS.findall(t or "")), plain_collapsed(words, found)) for i, t in [*enumerate(texts), (4, texts[4])]]
    assert sorted(got) == sorted(want)
    assert runs.find_runs(frame.limit(0)).count() == 0


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(80)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "a a a a a a a"), (-7, "b c " * 9), (4, "one"), (4, "one"), (1002, "ü\n\nü ü ü\tü ü ü ß")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, h string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in rows:
        words = WORDS.findall(text or "")
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        found = plain_runs(words)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((i, len(found), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None, sha(lines), sha(plain_collapsed(words, found))))
    got = query_defs.op13_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 10


# --- rules, samples and schedules of earlier operators


def test_url_rules_with_an_empty_path(spark):
    from kelpline.llm.url_filter import judge_urls

    rules = (("block", "a.org", ""), ("allow", "a.org", "/ok/"), ("block", "net", "/x"))
    urls = ["http://a.org", "http://a.org/", "http://b.a.org/x?y", "http://a.org/ok/1", "http://ba.org/x", "http://c.net/x", "http://c.net", None, "http://a.org/" + "p/" * 20_000]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, k string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
    none, own = (None, "allow"), ("a.org", "block")
    assert got == {0: own, 1: own, 2: own, 3: ("a.org/ok/", "allow"), 4: none, 5: ("net/x", "block"), 6: none, 7: none, 8: own}


def test_samples_are_bounded(spark):
    from kelpline.llm.langid import hash_limit, least_by_hash

    rows = spark.range(20_000).withColumnRenamed("id", "k")
    for wanted in (1, 50, 3000, 30_000):
        assert least_by_hash(rows, F.col("k"), "s", 20_000, wanted).count() == min(wanted, 20_000)
    few = rows.where(F.xxhash64("k", F.lit("s")) <= hash_limit(20_000, 400)).count()
    assert 400 <= few < 900  # not many more than wanted are ever sorted
    assert hash_limit(10**13, 400) < -(2**63) + 2**40


def plain_boost(x, y, trees, depth, rate, bins, ridge=2.0):
    """The margins of boosted trees, every split tried row by row."""
    edges = [sorted({float(np.quantile(x[:, j], q)) for q in np.linspace(0, 1, bins)[1:-1]}) for j in range(x.shape[1])]
    one = min(max(sum(y) / len(y), 1e-4), 1 - 1e-4)
    margins = [math.log(one / (1 - one))] * len(y)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        grad, hess = [t - q for t, q in zip(y, p)], [max(q * (1 - q), 1e-6) for q in p]
        groups = [list(range(len(y)))]
        for _ in range(depth):
            split = []
            for own in groups:
                value = lambda rows: sum(grad[r] for r in rows) ** 2 / (sum(hess[r] for r in rows) + ridge)
                best, sides = 1e-6, (own, [])
                for j, cuts in enumerate(edges):
                    for cut in cuts:
                        low, high = [r for r in own if x[r, j] <= cut], [r for r in own if x[r, j] > cut]
                        if own and value(low) + value(high) - value(own) > best + 1e-12:
                            best, sides = value(low) + value(high) - value(own), (low, high)
                split += sides
            groups = split
        for own in groups:
            step = rate * sum(grad[r] for r in own) / (sum(hess[r] for r in own) + ridge)
            for r in own:
                margins[r] += step
    return margins


def test_boosting_and_calibration_equal_plain_versions():
    from kelpline.llm import toxicity

    rng = np.random.default_rng(12)
    x = np.column_stack([rng.normal(size=90), rng.normal(size=90).round(1), rng.integers(0, 3, 90).astype(float)])
    y = (x[:, 0] + x[:, 2] + rng.normal(size=90) > 1).astype(float)
    trees = toxicity.boost(x, y, trees=6, depth=3, rate=0.2, bins=12)
    assert np.allclose(trees.margins(x), plain_boost(x, y.tolist(), 6, 3, 0.2, 12))
    margins = trees.margins(x)
    centres, levels = toxicity.isotonic(margins, y)
    order = np.argsort(margins, kind="stable")
    t = y[order]
    least = [max(min(t[i : j + 1].mean() for j in range(k, len(t))) for i in range(k + 1)) for k in range(len(t))]  # the min-max form
    assert (np.diff(centres) > 0).all() and sorted({round(v, 9) for v in least}) == sorted({round(v, 9) for v in levels})
