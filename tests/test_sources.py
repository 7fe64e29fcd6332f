"""Checks in the plan, arriving sessions, polygons, percentiles of a rough sketch."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.functions import scalars
from kinetrail.operators import intervals, metrics
from kinetrail.sources import scratch
from kinetrail.sources import tables as TB
from kinetrail.streaming.ingest import ingest_sessions


def test_labels_are_checked_where_they_are_read(spark):
    rows = [("rearing", 1, 5), ("grooming", 7, 7)]
    good = spark.createDataFrame(rows, "behavior string, start_frame long, end_frame long")
    assert TB.checked_labels(good).count() == 2
    for bad in [("flying", 1, 2), (None, 1, 2), ("rearing", 5, 4)]:
        df = TB.checked_labels(good.unionByName(spark.createDataFrame([bad], good.schema)))
        for read in (df.count, df.select("end_frame").collect):  # also where no checked column is asked for
            with pytest.raises(Exception, match="unknown behaviours"):
                read()


def test_frames_are_checked_where_they_are_read(spark):
    once = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "s int, frame long")
    assert TB.unique_frames(once, ["s", "frame"]).columns == ["s", "frame"] and TB.unique_frames(once, ["s", "frame"]).count() == 3
    with pytest.raises(Exception, match="duplicate frames"):
        TB.unique_frames(once, ["frame"]).count()


def test_a_session_in_three_batches(spark):
    rows = [(s, "x", 10 * i, 10 * i + 12) for s in ("a", "b") for i in range(6)]
    schema = "session_id string, behavior string, start_frame long, end_frame long"
    home, out, state = (scratch.fresh_path(spark, n) for n in ("home", "out", "state"))
    merge = lambda d: intervals.merge_intervals(d, ["session_id", "behavior"])
    want = sorted(map(tuple, merge(spark.createDataFrame(rows, schema)).select("session_id", "behavior", "start_frame", "end_frame").collect()))
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(home)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(home)
        ingest_sessions(stream, merge, out, state).awaitTermination()
    read = lambda: sorted(map(tuple, spark.read.schema(schema).parquet(out).select("session_id", "behavior", "start_frame", "end_frame").collect()))
    assert read() == want and len(want) == 2
    # all batches once more, under the same rows
    again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(home)
    ingest_sessions(again, merge, out, state + "-again").awaitTermination()
    assert read() == want


def plain_distance(x, y, corners):
    inside, near = False, math.inf
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
        d = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d)) if d else 0
        near = min(near, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return near if inside else -near


@pytest.mark.parametrize("corners", [3, 4, 5, 9])
def test_polygons_of_any_number_of_corners(spark, corners):
    rng = random.Random(corners)
    polygon = [(10 * math.cos(2 * math.pi * i / corners) * (1 + i % 2), 10 * math.sin(2 * math.pi * i / corners)) for i in range(corners)]
    points = [(rng.uniform(-20, 20), rng.uniform(-15, 15)) for _ in range(40)]
    df = spark.createDataFrame([(x, y, polygon) for x, y in points] + [(None, 1.0, polygon), (1.0, 1.0, None)], "x double, y double, polygon array<struct<x:double,y:double>>")
    got = [r[0] for r in df.select(scalars.floor_distance(F.col("x"), F.col("y"), F.col("polygon"))).collect()]
    assert got[:-2] == pytest.approx([plain_distance(x, y, polygon) for x, y in points]) and got[-2:] == [None, None]


def test_a_rough_sketch_is_widened(spark, monkeypatch):
    monkeypatch.setattr(metrics, "ONE_TASK", 0)
    x = np.random.default_rng(1).exponential(size=5_000) ** 4
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7)
    for accuracy in (2, 5, 400):
        got = metrics.global_percentiles(df, {"x": F.col("x")}, [0.01, 0.5, 0.77, 0.999], accuracy=accuracy)["x"]
        assert got == pytest.approx(np.quantile(x, [0.01, 0.5, 0.77, 0.999]), rel=1e-9)


def test_sessions_are_written_without_a_process_per_file(spark, tmp_path):
    ids = ["001", "S1", "a b+c:d%e", "é/x=1"]
    rows = [(s, f, f"{s}, \"{f}\"") for s in ids for f in range(50)]
    df = spark.createDataFrame(rows, "session_id string, frame long, note string").repartition(3)
    TB.write_sessions(df, f"file://{tmp_path}/sessions")
    assert len(list((tmp_path / "sessions").iterdir())) == len(ids)
    files = list((tmp_path / "sessions").rglob("*"))
    assert [f.name for f in files if f.is_file()] == ["part.csv"] * len(ids)  # and no checksum beside it
    kept = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    got = TB.read_sessions(spark, f"{tmp_path}/sessions", TB.struct("frame long, note string"))
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == kept


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"session_id=S{i}").mkdir()
        (tmp_path / f"session_id=S{i}" / "a.csv").write_text(f"frame\n{i}\n")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        got = TB.read_sessions(spark, str(tmp_path), TB.struct("frame long"))
        status = spark.sparkContext.statusTracker()
        stages = [s for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
        assert stages and all(status.getStageInfo(s).numTasks <= 32 for s in stages)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got.collect())) == sorted((f"S{i}", i) for i in range(200))


def test_columns_in_folder_names_are_looked_for_where_they_are_asked_for(spark, tmp_path):
    for day in (1, 2):
        (tmp_path / f"day={day}" / f"session_id=00{day}").mkdir(parents=True)
        (tmp_path / f"day={day}" / f"session_id=00{day}" / "a.csv").write_text("frame\n7\n")
    plain = TB.read_sessions(spark, str(tmp_path), TB.struct("frame long"))
    assert sorted(map(tuple, plain.collect())) == [("001", 7), ("002", 7)]
    assert plain._jdf.queryExecution().toString().count("day") == str(tmp_path).count("day")  # no folder was parsed for columns
    dated = TB.read_sessions(spark, str(tmp_path), TB.struct("frame long, day long"))
    assert sorted(map(tuple, dated.collect())) == [("001", 7, 1), ("002", 7, 2)]
