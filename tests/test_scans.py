"""Chunked scans against plain loops: any chunk size gives the same answer."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mailfleet.plans import scan
from tests.compare import rows_of


def samples(seed: int, n: int = 300, keys: str = "abc"):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(5000), n))
    # One key holds most rows.
    return [(rng.choice(keys[0] * 8 + keys), t, rng.randrange(-5, 9)) for t in times]


def by_key(rows):
    out: dict[str, list] = {}
    for k, t, v in rows:
        out.setdefault(k, []).append((t, v))
    return out


@pytest.mark.parametrize("size", [1, 37, 700, 10_000])
def test_previous_and_following(spark, size):
    rows = samples(1)
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    chunk = scan.id_chunk("t", size)
    got = scan.previous(df, ["k"], ["t"], chunk, F.col("v"), "p")
    got = scan.following(got, ["k"], ["t"], chunk, F.col("v"), "f")
    want = set()
    for k, items in by_key(rows).items():
        for i, (t, v) in enumerate(items):
            before = items[i - 1][1] if i else None
            after = items[i + 1][1] if i + 1 < len(items) else None
            want.add((k, t, v, before, after))
    assert {tuple(r) for r in got.select("k", "t", "v", "p", "f").collect()} == want


@pytest.mark.parametrize("size", [1, 37, 10_000])
def test_running_sum_and_max(spark, size):
    rows = samples(2)
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    chunk = scan.id_chunk("t", size)
    got = scan.running(df, ["k"], ["t"], chunk, F.col("v"), "s")
    got = scan.running(got, ["k"], ["t"], chunk, F.col("v"), "m", how="max")
    got = scan.running(got, ["k"], ["t"], chunk, F.col("v"), "b", how="max", before=True)
    want = set()
    for k, items in by_key(rows).items():
        total, top = 0, None
        for t, v in items:
            before, total = top, total + v
            top = v if top is None else max(top, v)
            want.add((k, t, total, top, before))
    assert {tuple(r) for r in got.select("k", "t", "s", "m", "b").collect()} == want


@pytest.mark.parametrize("size", [5, 100, 10_000])
def test_segments(spark, size):
    rows = samples(3)
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    gap = F.when(F.col("k") == "a", 25).otherwise(60)
    got = scan.segments(df, ["k"], "t", scan.id_chunk("t", size), gap, "n")
    want = set()
    for k, items in by_key(rows).items():
        number, before = 0, None
        for t, _ in items:
            if before is None or t - before >= (25 if k == "a" else 60):
                number += 1
            want.add((k, t, number))
            before = t
    assert {tuple(r) for r in got.select("k", "t", "n").collect()} == want


def test_trailing_count(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), rng.randrange(2000)) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, t bigint").select(
        "k", F.timestamp_seconds("t").alias("ts")
    )
    span = F.when(F.col("k") == "a", 30).otherwise(200)
    seconds = scan.per_second(df, ["k"], "ts")
    got = scan.trailing_count(seconds, ["k"], span, 600, "c")
    want = set()
    for k, t in set(rows):
        back = 30 if k == "a" else 200
        want.add((k, t, sum(1 for q, s in rows if q == k and t - back <= s <= t)))
    assert {tuple(r) for r in got.select("k", "second", "c").collect()} == want


def test_range_chunks_split_a_hot_key(spark):
    rows = [("hot" if i % 3 else "k%d" % (i % 7), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t bigint")
    cut = scan.range_chunks(df, ["k"], ["t"], parts=6)
    assert cut.where("k = 'hot'").select("chunk").distinct().count() > 1
    hourly = scan.id_chunk("t", 10**6)
    assert scan.balanced(df, ["k"], ["t"], hourly, "c").select("c").distinct().count() == 1
    assert scan.balanced(df, ["k"], ["t"], hourly, "c", most=500).select("c").distinct().count() > 1
    got = scan.previous(cut, ["k"], ["t"], F.col("chunk"), F.col("t"), "p")
    last: dict[str, int] = {}
    want = set()
    for k, t in rows:
        want.add((k, t, last.get(k)))
        last[k] = t
    assert {tuple(r) for r in got.select("k", "t", "p").collect()} == want


def test_growth_over_chunks(spark):
    """Streaks that span chunks, chunks of one row, nulls, and a null key."""
    rng = random.Random(5)
    rows, want = [], []
    for key in ("a", "b", None):
        before, streak = None, 0
        for i in range(400):
            v = rng.choice([None, i, i, i, rng.randrange(400)]) if rng.random() < 0.3 else (before or 0) + 1
            streak = streak + 1 if v is not None and before is not None and v > before else 0
            rows.append((key, i, v))
            want.append((key, i, before, streak))
            before = v
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    for size in (1, 7, 100, 1000):
        got = scan.growth(df, ["k"], ["i"], F.floor(F.col("i") / size), F.col("v"), "before", "streak")
        assert rows_of(got, "k", "i", "before", "streak") == sorted(want, key=repr), size


def test_trend_takes_few_exchanges(spark, folder):
    from mailfleet.operators.health import queue_trend
    from mailfleet.sources.fixtures import Views

    plan = queue_trend(Views(spark, folder)("fx_sample"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 6


def test_first_at_or_after(spark):
    rng = random.Random(2)
    points = [(k, p, p * 3) for k in ("a", None) for p in rng.sample(range(500), 40)]
    asked = [(rng.choice(["a", "b", None]), rng.randrange(-20, 520)) for _ in range(200)]
    got = scan.first_at_or_after(
        spark.createDataFrame(asked, "k string, x bigint"), spark.createDataFrame(points, "k string, pos bigint, v bigint"),
        ["k"], F.col("x"), "pos", "v", 30, "found")
    want = [(k, x, min((v for kk, p, v in points if kk == k and p >= x), default=None)) for k, x in asked]
    assert rows_of(got, "k", "x", "found") == sorted(want, key=repr)
