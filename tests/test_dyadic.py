"""Joins by aligned spans against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from kinetrail.operators import dyadic, intervals


def cover(spark, rows):
    df = spark.createDataFrame(rows, "s long, e long")
    return [[(x["level"], x["at"]) for x in r[0]] if r[0] is not None else None for r in df.select(dyadic.spans("s", "e")).collect()]


def test_spans_are_a_disjoint_cover(spark):
    rng = random.Random(1)
    rows = [(a, a + rng.choice([0, 5, 3000, 70_000, 10**6])) for a in (rng.randint(-(10**6), 10**7) for _ in range(60))]
    for (s, e), found in zip(rows, cover(spark, rows), strict=True):
        buckets = sorted(b for level, at in found for b in range(at << (2 * level), (at + 1) << (2 * level)))
        assert buckets == list(range(s >> 10, (e >> 10) + 1))
    assert cover(spark, [(5, 4), (7, 7)]) == [None, [(0, 0)]]


def test_a_long_interval_is_few_rows(spark):
    assert max(map(len, cover(spark, [(k, k + 10**8) for k in (0, 1023, 123_457, 99_999_999)]))) < 60


@pytest.mark.parametrize("margin", [0, 700])
def test_pairs_are_found_once(spark, margin):
    rng = random.Random(2)
    make = lambda n: [(rng.randint(0, 2), s, s + rng.choice([0, 3, 900, 5000, 200_000])) for s in (rng.randint(-5000, 400_000) for _ in range(n))]
    a, b = list(set(make(80))), list(set(make(80)))
    left = spark.createDataFrame(a, "k int, start long, end long").repartition(3)
    right = spark.createDataFrame(b, "k int, _s long, _e long")
    got = sorted(tuple(r) for r in dyadic.meeting(left, right, ["k"], margin=margin).collect())
    want = sorted((k, s, e, x, y) for k, s, e in a for j, x, y in b if j == k and s - margin <= y and x <= e + margin)
    assert got == want and want
    frames = sorted({(k, s + d) for k, s, _ in b for d in (0, 1, 5000)})
    held = intervals.range_join(
        spark.createDataFrame(frames, "k int, frame long"), left.select("k", F.col("start").alias("start_frame"), F.col("end").alias("end_frame")), ["k"]
    )
    assert sorted(tuple(r) for r in held.collect()) == sorted((k, f, s, e) for k, f in frames for j, s, e in a if j == k and s <= f <= e)
    assert dyadic.meeting(left.limit(0), right, ["k"]).count() == 0
