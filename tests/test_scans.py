"""Scans that cut a session in blocks give what one pass over it gives."""

import random

import pytest
from pyspark.sql import functions as F

from kinetrail.operators import detectors, intervals, scans
from kinetrail.operators import timeseries as TS

from .test_series import circle

KEYS = ["s"]


@pytest.fixture(scope="module")
def rows():
    """Sessions with holes, long runs over several blocks, flicker, null flags."""
    rng, out = random.Random(7), []
    for s, n in enumerate((1, 40, 333, 1000)):
        frame, flag = rng.randint(-30, 60), True
        for i in range(n):
            flag = flag if i % 200 > 60 or rng.random() < 0.7 else not flag
            out.append((s, frame, None if rng.random() < 0.02 and s == 2 else flag, rng.randint(0, 9) / 4))
            frame += 1 if rng.random() < 0.9 else rng.randint(2, 150)
    rng.shuffle(out)
    return out


def sessions(rows):
    found = {}
    for s, *row in sorted(rows):
        found.setdefault(s, []).append(row)
    return found


def plain_runs(flags):
    out, start = [], 0
    for i in range(1, len(flags) + 1):
        if i == len(flags) or flags[i] != flags[start]:
            out.append((start, i - 1, flags[start]))
            start = i
    return out


@pytest.mark.parametrize("block", [1, 7, 64, 100_000])
def test_runs_positions_and_sums(spark, monkeypatch, rows, block):
    monkeypatch.setattr(scans, "BLOCK", block)
    df = spark.createDataFrame(rows, "s int, frame long, m boolean, v double").repartition(5)
    own = sessions(rows)
    got = {}
    for r in scans.flag_runs(df, "m", KEYS).orderBy("s", "start").collect():
        got.setdefault(r["s"], []).append((r["start"], r["end"], r["flag"]))
    assert got == {s: plain_runs([bool(x[1]) for x in v]) for s, v in own.items()}
    frames = sorted(tuple(r) for r in intervals.mask_to_bouts(df, "m", KEYS, 3).collect())
    want = []
    for s, v in own.items():
        for f in (x[0] for x in v if x[1]):
            if want and want[-1][0] == s and f - want[-1][2] <= 3:
                want[-1][2] = f
            else:
                want.append([s, f, f])
    assert frames == sorted(map(tuple, want))
    placed = {(r["s"], r["frame"]): r["pos"] for r in scans.with_position(df, KEYS).collect()}
    assert placed == {(s, x[0]): i for s, v in own.items() for i, x in enumerate(v)}
    summed = {(r["s"], r["frame"]): r["sum"] for r in scans.running_sum(df, F.col("v"), KEYS, "sum").collect()}
    assert summed == {(s, x[0]): sum(y[2] for y in v[: i + 1]) for s, v in own.items() for i, x in enumerate(v)}
    count = {r["s"]: r["n_bouts"] for r in intervals.bout_count(df, "m", KEYS).collect()}
    assert count == {s: sum(f for _, _, f in plain_runs([bool(x[1]) for x in v])) for s, v in own.items()}
    first = {r["s"]: r["at"] for r in intervals.first_long_bout(df, "m", 30, KEYS, "at").collect()}
    assert first == {s: min((a for a, b, f in plain_runs([bool(x[1]) for x in v]) if f and b - a >= 29), default=0) for s, v in own.items()}


def test_both_passes_read_one_exchange(spark, rows, capsys):
    df = spark.createDataFrame(rows, "s int, frame long, m boolean, v double").repartition(5)
    found = scans._runs(df, F.coalesce("m", F.lit(False)), lambda a, b: a != b, KEYS, "frame", 64)
    found.collect()
    found.explain()
    assert "ReusedExchange" in capsys.readouterr().out


def test_windows_in_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(scans, "BUCKET", 8)
    df = spark.createDataFrame(rows, "s int, frame long, m boolean, v double").repartition(5)

    def chain(d, keys):
        d = d.withColumn("smooth", TS.smooth("v", 9, keys)).withColumn("step", F.col("v") - F.lag("v").over(TS.over(keys)))
        return intervals.sustained(d, F.col("smooth") > 0.5, 12, keys, "long")

    want = sorted(map(tuple, chain(df, KEYS).collect()), key=str)
    for size in (80, 200, 10**6):
        got = scans.in_blocks(df, KEYS, 4 + 12, chain, rows=size)
        assert got.columns == [*df.columns, "smooth", "step", "long"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    with pytest.raises(ValueError):
        scans.in_blocks(df, KEYS, 100, chain, rows=100)


def test_triage_of_a_long_session_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(scans, "BUCKET", 16)
    rng, x, y, out = random.Random(2), 50.0, 50.0, []
    for i in range(2500):
        fast = 4.0 if i % 300 < 120 else 0.2
        x, y = x + rng.uniform(-0.5, 1) * fast, y + rng.uniform(-1, 1) * fast
        x = x % 400
        p = 0.1 if rng.random() < 0.05 else 0.9
        point = lambda dx, dy: (x + dx + rng.random(), y + dy + rng.random(), p)  # noqa: E731,B023
        out.append(("S", 0, i + (i // 90) * 5, i * 33.3, *point(0, -9), *point(-3, -6), *point(3, -6), *point(0, -4), *point(0, 0), *point(0, 9)))
    names = [f"{k}_{a} double" for k in ("nose", "ear_left", "ear_right", "neck", "body", "tail_base") for a in "xyp"]
    pose = spark.createDataFrame(out, "session_id string, field int, frame long, time_ms double, " + ", ".join(names))
    objects = circle(spark, (100, 60, 20), (300, 60, 30), (310, 70, 30))
    whole = detectors.triage(TS.frame_kinematics(pose, distances=False), objects)
    chain = lambda d, keys: detectors.triage(TS.frame_kinematics(d, keys=keys, distances=False), None, keys=keys)
    cut = scans.in_blocks(detectors.with_objects(pose, objects), TS.KEYS, detectors.REACH, chain, rows=600)
    cols = ["frame", "walking", "freezing", "low_activity", "object_interaction", "active_head", "review"]
    want = sorted(map(tuple, whole.select(cols).collect()))
    assert sorted(map(tuple, cut.select(cols).collect())) == want
    assert all(len({r[i] for r in want}) == 2 for i in (1, 4, 6))


def test_counts_after_arrival(spark):
    """Only what begins after arrival counts, also where a window outlasts the session."""
    from kinetrail.operators import statistics

    frames = spark.createDataFrame([("a", i, float(2 * i)) for i in range(100)] + [("b", i, 0.0) for i in range(5)], "session_id string, pos long, distance double")
    arrivals = spark.createDataFrame([("a", 10), ("b", 0)], "session_id string, arrival long")
    episodes = spark.createDataFrame([("a", s) for s in (3, 10, 29, 30, 95)], "session_id string, start long")
    own = spark.createDataFrame([("a", 4.0, 2.0, 5.0, 1.0), ("b", 0.0, 0.0, 1.0, 1.0)], "session_id string, reference_s double, reference_l double, metres_s double, metres_l double")
    got = {r["session_id"]: r for r in statistics.reference_counts(episodes, arrivals, frames, own, {"s": 20, "l": 1000}).collect()}
    a, b = got["a"], got["b"]
    assert (a["count_s"], a["count_l"], a["ratio_s"], a["ratio_l"]) == (2, 4, 0.5, 2.0)
    assert (a["distance_s"], a["distance_l"], a["px_per_m_s"]) == (38.0, 178.0, 38.0 / 5)
    assert (b["count_l"], b["distance_l"], b["ratio_s"]) == (0, 0.0, None)
    summary = statistics.reference_summary(spark.createDataFrame(list(got.values())), ["s", "l"]).collect()
    assert [r["window"] for r in summary] == ["s", "l"] and summary[0]["median_ratio"] == 0.5
