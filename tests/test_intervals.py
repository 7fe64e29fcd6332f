"""Facts of the interval algebra on small inputs, and its invariants."""

import random

import pytest

from kinetrail.functions import scalars
from kinetrail.operators import intervals, metrics, review
from pyspark.sql import functions as F

KEY = ["s"]


def mask(spark, *sessions):
    return spark.createDataFrame([(i, f, bool(v)) for i, m in enumerate(sessions) for f, v in enumerate(m)], "s int, frame long, m boolean")


def flags(df, out):
    got = {}
    for r in df.orderBy("s", "frame").collect():
        got.setdefault(r["s"], []).append(int(r[out]))
    return got


def spans(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_expansion_needs_recorded_frames(spark):
    frames = spark.createDataFrame([(0, f) for f in (*range(5), 8, 9, 10)], "s int, frame long")
    walk = spark.createDataFrame([(0, 2, 9)], "s int, start_frame long, end_frame long")
    out = intervals.intervals_to_mask(frames, walk, KEY, "m")
    assert flags(out, "m")[0] == [0, 0, 1, 1, 1, 1, 1, 0]


def test_gap_of_frames_splits(spark):
    df = spark.createDataFrame([(0, f, True) for f in (0, 1, 3, 30, 31)], "s int, frame long, m boolean")
    assert spans(intervals.mask_to_bouts(df, "m", KEY, 2), "start_frame", "end_frame") == [(0, 3), (30, 31)]


def test_iou(spark):
    row = spark.range(1).select(scalars.interval_iou(*map(F.lit, (0, 9, 5, 14))).alias("x"), scalars.interval_iou(*map(F.lit, (0, 1, 5, 6))).alias("y")).first()
    assert row["x"] == pytest.approx(1 / 3) and row["y"] == 0


def test_merge_and_audit(spark):
    df = spark.createDataFrame([(0, 0, 4), (0, 5, 9), (0, 12, 14), (0, 13, 20), (1, 0, 1)], "s int, start_frame long, end_frame long")
    assert spans(intervals.merge_intervals(df, KEY), "s", "start_frame", "end_frame") == [(0, 0, 9), (0, 12, 20), (1, 0, 1)]
    assert spans(intervals.merge_intervals(df, KEY, 3), "s", "start_frame", "end_frame") == [(0, 0, 20), (1, 0, 1)]
    assert spans(intervals.overlap_audit(df, KEY), "start_frame") == [(13,)]


def test_ranges_round_trip(spark):
    m = [f in (2, 3, 4, 9, *range(15, 20)) for f in range(25)]
    text = intervals.encode_ranges(mask(spark, m), "m", KEY)
    assert text.first()["ranges"] == "2-4;9-9;15-19"
    assert spans(intervals.decode_ranges(text, "ranges", KEY), "start_frame", "end_frame") == [(2, 4), (9, 9), (15, 19)]


def test_pair_rule_joins_two(spark):
    m = [0 <= f < 60 or 72 <= f < 132 or 144 <= f < 204 for f in range(210)]
    joined = intervals.join_episodes(mask(spark, m), "m", KEY, "j")
    assert spans(intervals.bouts(joined, "j", KEY), "start", "end") == [(0, 131), (144, 203)]
    closed = intervals.close_gaps(mask(spark, m), "m", 15, KEY, "j")
    assert spans(intervals.bouts(closed, "j", KEY), "start", "end") == [(0, 203)]


def loop_join(m, gap, most):
    out, runs, start = list(m), [], None
    for i, v in enumerate([*m, False]):
        if v and start is None:
            start = i
        elif not v and start is not None:
            runs.append((start, i - 1))
            start = None
    joined = 1
    for (_, end), (begin, _) in zip(runs, runs[1:], strict=False):
        if (begin - end) / 30 < gap and joined < most:
            out[end:begin] = [True] * (begin - end)
            joined += 1
        else:
            joined = 1
    return [int(x) for x in out]


def test_pair_rule_equals_a_counter(spark):
    rng = random.Random(1)
    masks = [[rng.random() < 0.6 for _ in range(60)] for _ in range(40)]
    got = flags(intervals.join_episodes(mask(spark, *masks), "m", KEY, "j", gap_sec=0.15, max_join=3), "j")
    assert got == {i: loop_join(m, 0.15, 3) for i, m in enumerate(masks)}


def test_sustained_and_seconds(spark):
    m = [1, 1, 0, 1, 1, 1, 0]
    assert flags(intervals.sustained(mask(spark, m), "m", 3, KEY, "o"), "o")[0] == [0, 0, 0, 1, 1, 1, 0]
    held = intervals.run_seconds(mask(spark, m), "m", KEY, "o", fps=1, cap=2).orderBy("frame").collect()
    assert [r["o"] for r in held] == [1, 2, 0, 1, 2, 2, 0]


def test_null_flags_are_false_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([(0, 0, None), (0, 1, True)], "s int, frame long, m boolean")
    assert flags(intervals.sustained(df, "m", 2, KEY, "o"), "o")[0] == [0, 0]
    empty = df.filter("s = 9")
    for out in (intervals.bouts(empty, "m", KEY), intervals.close_gaps(empty, "m", 2, KEY, "o"), intervals.join_episodes(empty, "m", KEY, "o")):
        assert out.count() == 0


def test_matching_counts_once(spark):
    b = lambda rows: spark.createDataFrame([(0, *r) for r in rows], "s int, start long, end long")
    matched = lambda x, y: metrics.matched_episodes(b(x), b(y), KEY).first()["matched"]
    assert matched([(0, 9), (12, 20)], [(0, 20)]) == 1
    assert matched([(0, 20)], [(0, 5), (9, 20)]) == 1
    assert matched([(0, 5), (9, 20)], [(1, 4), (10, 11)]) == 2


def test_matching_in_groups_is_matching_in_all(spark):
    rng = random.Random(5)
    cut = lambda: [(s, s + rng.randint(0, 14)) for s in sorted(rng.sample(range(600), 70))]
    true, pred = cut(), cut()
    iou = lambda x, y: max(0, min(x[1], y[1]) - max(x[0], y[0]) + 1) / (max(x[1], y[1]) - min(x[0], y[0]) + 1)
    pairs = sorted(((iou(x, y), i, j) for i, x in enumerate(true) for j, y in enumerate(pred) if iou(x, y) >= 0.2), reverse=True)
    want, used_a, used_b = [], set(), set()
    for _, i, j in pairs:
        if i not in used_a and j not in used_b:
            want.append((i, j))
            used_a.add(i), used_b.add(j)
    met = sorted((j, i) for i, x in enumerate(true) for j, y in enumerate(pred) if iou(x, y) > 0)
    first, used_a, used_b = 0, set(), set()
    for j, i in met:
        if i not in used_a and j not in used_b:
            first += 1
            used_a.add(i), used_b.add(j)
    table = lambda rows, a, b: spark.createDataFrame([("s", *r) for r in rows], f"session_id string, {a} long, {b} long")
    out = metrics.match_bouts(table(true, "start_frame", "end_frame"), table(pred, "start_frame", "end_frame"), ["session_id"], 0.2)
    base = min(r["true_index"] for r in out.collect()) - min(i for i, _ in want)
    assert sorted((r["true_index"] - base, r["pred_index"] - base) for r in out.collect()) == sorted(want)
    assert metrics.matched_episodes(table(true, "start", "end"), table(pred, "start", "end"), ["session_id"]).first()["matched"] == first


def test_groups_chain(spark):
    ep = spark.createDataFrame([(0, "a", 0, 10), (0, "b", 8, 20), (0, "a", 19, 30), (0, "b", 50, 60)], "session_id int, lane string, start long, end long")
    assert spans(review.decision_groups(ep), "start", "end", "status") == [(0, 30, "both"), (50, 60, "only_b")]


def test_long_intervals_cross_buckets(spark):
    frames = spark.createDataFrame([(0, f) for f in range(0, 5000, 7)], "s int, frame long")
    one = spark.createDataFrame([(0, 1000, 3500), (0, 1020, 1030)], "s int, start_frame long, end_frame long")
    got = intervals.intervals_to_mask(frames, one, KEY, "m")
    assert flags(got, "m")[0] == [int(1000 <= f <= 3500) for f in range(0, 5000, 7)]
