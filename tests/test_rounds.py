"""Choices in rounds equal the walks that define them."""

import random

import pytest
from pyspark.sql import functions as F

from kinetrail.operators import detectors, intervals, metrics, sampling


def plain_match(true, pred, threshold):
    pairs = []
    for i, (a, b) in enumerate(true):
        for j, (c, d) in enumerate(pred):
            common = min(b, d) - max(a, c) + 1
            if common > 0:
                iou = common / (b - a + 1 + d - c + 1 - common)
                if iou >= threshold:
                    pairs.append((iou, i, j))
    used, out = set(), []
    for iou, i, j in sorted(pairs, reverse=True):
        if ("t", i) not in used and ("p", j) not in used:
            used |= {("t", i), ("p", j)}
            out.append((i, j))
    return sorted(out)


def side(rng, n, disjoint=True):
    at, out = 0, []
    for _ in range(n):
        at += rng.randint(1, 6) if disjoint else rng.randint(0, 3)
        end = at + rng.randint(0, 25)
        out.append((at, end))
        at = end if disjoint else at
    return sorted(set(out))


def frame(spark, sides):
    rows = [(k, a, b) for k, own in enumerate(sides) for a, b in own]
    return spark.createDataFrame(rows, "k int, start long, end long").repartition(3)


@pytest.mark.parametrize("rounds,threshold,disjoint", [(12, 0.5, True), (12, 0.1, True), (1, 0.05, True), (0, 0.1, True), (12, 0.2, False)])
def test_matching(spark, monkeypatch, rounds, threshold, disjoint):
    monkeypatch.setattr(metrics, "ROUNDS", rounds)
    rng = random.Random(5)
    true, pred = ([side(rng, 60, disjoint) for _ in range(3)] for _ in "tp")
    if not disjoint:  # bouts of one beginning have no order of their own
        true, pred = ([list({a: (a, b) for a, b in own}.values()) for own in x] for x in (true, pred))
    got = metrics.match_bouts(frame(spark, true), frame(spark, pred), ["k"], threshold, "start", "end").collect()
    for k in range(3):
        want = plain_match(sorted(true[k]), sorted(pred[k]), threshold)
        assert sorted((r["true_index"], r["pred_index"]) for r in got if r["k"] == k) == want and want


def test_a_chain_of_a_hundred_thousand(spark):
    """Every bout overlaps the next one, each time a little less."""
    n = 50_000
    rows = spark.range(n).select(F.lit(1).alias("k"), "id")
    true = rows.select("k", (F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 700).alias("end"))
    pred = rows.select("k", (F.col("id") * 1000 + 400).alias("start"), (F.col("id") * 1000 + 1100).alias("end"))
    got = metrics.match_bouts(true, pred, ["k"], 0.05, "start", "end")
    assert got.count() == n and got.filter("true_index = pred_index").count() == n
    hits = metrics.episode_hits(true, pred, ["k"]).first()
    assert (hits["matched"], hits["hits"], hits["real"]) == (n, n, n)


def test_first_unused_mark(spark):
    rng = random.Random(8)
    marked, found = ([side(rng, 80) for _ in range(6)] for _ in "mf")
    marked.append([(0, 100)])
    found.append([(1, 2), (5, 8), (90, 120)])
    got = {r["k"]: r for r in metrics.episode_hits(frame(spark, marked), frame(spark, found), ["k"]).collect()}
    for k, (m, f) in enumerate(zip(marked, found, strict=True)):
        meet = lambda x, y: x[0] <= y[1] and y[0] <= x[1]
        used = set()
        for x in f:
            free = [i for i, y in enumerate(m) if meet(x, y) and i not in used]
            used |= set(free[:1])
        assert got[k]["matched"] == len(used)
        assert got[k]["hits"] == sum(any(meet(x, y) for x in f) for y in m) and got[k]["real"] == sum(any(meet(x, y) for y in m) for x in f)


def test_thresholds_at_once(spark):
    rng = random.Random(4)
    rows = [(s, f * 2, rng.choice([None, *(i / 10 for i in range(11))]) if rng.random() < 0.5 else 0.9) for s in range(3) for f in range(200)]
    df = spark.createDataFrame(rows, "k int, frame long, score double").repartition(3)
    grid = [0.05, 0.3, 0.35, 0.9, 1.0]
    got = {tuple(r) for r in intervals.threshold_bouts(df, "score", grid, ["k"]).select("k", "level", "start", "end").collect()}
    want = {(r["k"], i, r["start"], r["end"]) for i, g in enumerate(grid) for r in intervals.bouts(df.withColumn("m", F.col("score") >= g), "m", ["k"]).collect()}
    assert got == want
    found = {tuple(r) for r in detectors.threshold_episodes(df, "score", grid, ["k"]).select("k", "level", "start", "end").collect()}
    want = set()
    for i, g in enumerate(grid):
        masked = detectors.gate(detectors.frame_mask(df, "score", g, "m", keys=["k"]), "m", "rearing", "g", keys=["k"])
        want |= {(r["k"], i, r["start"], r["end"]) for r in intervals.bouts(masked, "g", ["k"]).collect()}
    assert found == want
    with pytest.raises(ValueError):
        intervals.threshold_bouts(df, "score", [0.5, 0.5], ["k"])


def test_clips_in_rounds(spark):
    rng = random.Random(6)
    rows = list({(k, rng.choice("xyz"), s, s + rng.choice([4, 9])) for k in range(3) for s in (rng.randint(0, 400) for _ in range(150))})
    df = spark.createDataFrame(rows, "k int, stratum string, start long, end long").repartition(3)
    hashed = df.withColumn("h", sampling.shuffled(F.concat_ws(":", "stratum", sampling._tile_key(["k"])), 1)).collect()
    for quota in (7, 10**6):
        got = {tuple(r) for r in sampling.stratified_clips(df, ["x", "y", "z"], quota, ["k"], 1).select("k", "stratum", "start", "end").collect()}
        want = []
        for stratum in "xyz":
            n = 0
            for r in sorted((r for r in hashed if r["stratum"] == stratum), key=lambda r: (r["h"], r["start"], r["end"])):
                if n < quota and not any(k == r["k"] and a <= r["end"] and r["start"] <= b for k, _, a, b in want):
                    want.append((r["k"], stratum, r["start"], r["end"]))
                    n += 1
        assert got == set(want)
    assert sampling.stratified_clips(df, [], 5, ["k"]).count() == 0
