"""Detectors of one chain share their windows, and what is made of them is the same."""

import random

from pyspark.sql import functions as F

from kinetrail.functions import scalars
from kinetrail.operators import intervals, sampling
from kinetrail.operators import timeseries as TS
from kinetrail.plans import series_queries

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_triage_lists_every_window_once(spark):
    text = optimized(series_queries.triaged(spark, SF).select("session_id", "frame", "review"))
    assert text.count("collect_list(") <= 6
    assert text.count("Window [") <= 10


def test_medians_are_the_same_in_parts(spark):
    rng = random.Random(1)
    rows = [(s, 0, i, None if rng.random() < 0.3 else rng.random()) for s in range(2) for i in range(90)]
    df = spark.createDataFrame(rows, "session_id long, field long, frame long, v double")
    both = TS.smoothed(df, {"a": ("v", 9), "b": ("v", 70), "c": ("v", 1)})
    for out, n in (("a", 9), ("b", 70), ("c", 1)):
        both = both.withColumn("_w", TS.smooth("v", n)).withColumn(f"same_{out}", F.col("_w").eqNullSafe(F.col(out)))
    assert both.filter("not (same_a and same_b and same_c)").count() == 0


def test_flags_share_windows(spark):
    rng = random.Random(2)
    rows = [(s, i, rng.random() < 0.8, rng.choice([True, True, False, None])) for s in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "session_id long, frame long, f boolean, g boolean")
    both = intervals.sustained_each(df, {"x": ("f", 5), "y": ("g", 3), "z": ("g", 1), "l": ("f", 150)}, ["session_id"])
    assert both.columns == ["session_id", "frame", "f", "g", "x", "y", "z", "l"]
    for out, flag, n in (("x", "f", 5), ("y", "g", 3), ("z", "g", 1), ("l", "f", 150)):
        both = intervals.sustained(both, flag, n, ["session_id"], f"own_{out}")
    assert both.filter("x <> own_x or y <> own_y or z <> own_z or l <> own_l").count() == 0


def test_windows_that_meet_nothing_are_not_compared(spark, monkeypatch):
    rows = [(1, 0, 4, "c"), (1, 5, 9, "b"), (1, 9, 12, "a"), (1, 20, 24, "d"), (1, 20, 24, "e"), (2, 0, 600000, "f"), (2, 500000, 500004, "a"), (2, 700000, 700001, "z")]
    df = spark.createDataFrame(rows, "session_id long, start long, end long, _h string")
    compared = []
    meeting = sampling.meeting
    monkeypatch.setattr(sampling, "meeting", lambda a, b, keys: compared.append(a.count()) or meeting(a, b, keys))
    got = {(r.session_id, r.start, r.end) for r in sampling.first_come(df, ["session_id"]).collect()}
    assert got == {(1, 0, 4), (1, 9, 12), (1, 20, 24), (2, 500000, 500004), (2, 700000, 700001)}
    assert compared == [5]
    apart = spark.createDataFrame([(1, 0, 4, "b"), (1, 5, 9, "a")], df.schema)
    assert sampling.first_come(apart, ["session_id"]).count() == 2 and len(compared) == 1


def test_sides_of_floors_are_worked_off_in_batches(spark):
    text = optimized(series_queries.with_floor(spark, SF))
    assert "lambdafunction" not in text and "distance(" in text


def test_points_and_polygons_that_are_missing(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rows = [(5.0, 4.0, square), (5.0, None, square), (1.0, 1.0, None), (1.0, 1.0, []), (12.0, 5.0, square), (3.0, 3.0, [(3.0, 5.0)]), (5.0, 0.0, square)]
    df = spark.createDataFrame(rows, "x double, y double, p array<struct<x:double,y:double>>")
    got = df.select(scalars.floor_distance(F.col("x"), F.col("y"), F.col("p")), scalars.in_polygon(F.col("x"), F.col("y"), F.col("p"))).collect()
    assert [r[0] for r in got] == [4.0, None, None, None, -2.0, -2.0, got[6][0]] and got[6][0] == 0.0
    assert [r[1] for r in got][:6] == [True, False, False, False, False, False]
