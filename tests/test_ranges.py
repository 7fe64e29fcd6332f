"""Global orders and percentiles that are worked out in ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.operators import clips, metrics, sampling
from kinetrail.operators import timeseries as TS
from kinetrail.sources import tables as TB


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_percentiles_are_exact(spark, monkeypatch, one_task):
    monkeypatch.setattr(metrics, "ONE_TASK", one_task)
    rng = np.random.default_rng(3)
    x = rng.normal(size=20_001)
    y = np.where(rng.random(20_001) < 0.4, 0.5, np.round(x, 2))  # ties, a hot value
    y[rng.random(20_001) < 0.05] = np.inf
    rows = [(float(a), float(b), None) for a, b in zip(x, y, strict=True)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    shares = [0.0, 0.05, 0.1, 0.333, 0.5, 0.8, 0.9, 1.0]
    got = metrics.global_percentiles(df, {c: F.col(c) for c in "xyz"}, shares, accuracy=1_000)
    assert got["x"] == pytest.approx(np.quantile(x, shares), rel=1e-9)
    assert got["y"][:-1] == pytest.approx(np.quantile(y, shares[:-1]), rel=1e-9) and got["y"][-1] == np.inf
    assert got["z"] == [None] * len(shares)


def test_ranks_are_the_order_of_the_hash(spark):
    df = spark.range(5_000).withColumn("g", F.col("id") % 3)
    got = sampling.ranked_by_hash(df, F.md5(F.col("id").cast("string")), "r", ["g"]).withColumn("h", F.md5(F.col("id").cast("string"))).collect()
    assert len(got) == 5_000
    for g in range(3):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["h"])
        assert [r["r"] for r in own] == list(range(1, len(own) + 1))


def test_headers_are_carried_over_blocks(spark):
    at = {5: "Dia 1", 250_000: "Dia 2"}
    rows = [(i, at.get(i, ""), "" if i in at else "7", "1a") for i in (1, 5, 6, 99_999, 100_000, 249_999, 250_000, 250_001, 900_000)]
    df = spark.createDataFrame(rows, "line long, c0 string, c1 string, c2 string")
    for c in ("c3", "c5", "c11", "c12"):
        df = df.withColumn(c, F.lit("1"))
    got = sorted(r["day"] for r in TB.import_counts(df).collect())
    assert got == [1, 1, 1, 1, 2, 2]


def test_score_bands_leave_out_what_is_taken(spark):
    frames = spark.range(600).select(F.lit(1).alias("session_id"), F.col("id").alias("frame"), (F.col("id") / 600).alias("score"), F.lit(False).alias("missing"))
    taken = spark.createDataFrame([(1, 100, 129)], "session_id int, start long, end long")
    every = sampling.score_band_clips(frames, [0.5, 0.8], 30, 10**6, ["session_id"]).collect()
    free = sampling.score_band_clips(frames, [0.5, 0.8], 30, 10**6, ["session_id"], taken).collect()
    assert {r["clip_id"] for r in free} == {r["clip_id"] for r in every if r["start_frame"] > 159 or r["end_frame"] < 70}
    for name in ("band_00_50", "band_50_80", "band_80_100"):
        own = [r for r in every if r["triage_label"] == name]
        assert own and all(r["band_share"] == pytest.approx(len(own) / len(every)) for r in own)
    few = sampling.score_band_clips(frames, [0.5, 0.8], 30, 2, ["session_id"]).collect()
    assert len(few) == 6 and {tuple(r) for r in few} <= {tuple(r) for r in every}
    assert sampling.score_band_clips(frames.limit(0), [0.5], 30, 2, ["session_id"]).count() == 0
    assert clips.score_bands(frames, frames, [0.5]).count() == 600


def test_windows_are_the_same_in_blocks(spark, monkeypatch):
    rows = [(s, 0, f, None if (f * s) % 7 == 0 else float((f * 31 + s) % 97)) for s, n in ((1, 700), (2, 33), (3, 1)) for f in range(n)]
    df = spark.createDataFrame(rows, "session_id long, field long, frame long, v double")
    spec = {"v": ("mean", "median", "p10", "p90", "std", "trend")}
    both = lambda: (
        sorted(map(str, TS.centered_features(df, spec, (15, 60, 300)).collect())), sorted(map(str, TS.sliding_features(df, spec, 60, 15).collect()))
    )
    whole = both()
    monkeypatch.setattr(TS, "BLOCK", 50)
    assert both() == whole
    assert len(whole[0]) == 88 + 5 + 1 and len(whole[1]) == 43 + 1 + 1
    plain = {r["centre"]: r for r in TS.centered_features(df.filter("session_id = 1"), spec, (15,)).collect()}
    v = {r[2]: r[3] for r in rows if r[0] == 1}
    for centre, r in plain.items():
        own = [(i, v[i]) for i in range(max(0, centre - 7), min(700, centre + 8)) if v[i] is not None]
        late, early = [x for i, x in own if i >= centre], [x for i, x in own if i < centre]
        assert r["w15_v_median"] == pytest.approx(np.median([x for _, x in own]))
        assert r["w15_v_std"] == pytest.approx(np.std([x for _, x in own]))
        assert r["w15_v_trend"] == (pytest.approx(np.mean(late) - np.mean(early)) if late and early else None)
    assert TS.centered_features(df.limit(0), spec).count() == 0


def test_short_sessions_are_worked_off_together(spark):
    rows = [(s, 0, f, None if (f + s) % 5 == 0 else float((f * 13 + s) % 29)) for s in range(60) for f in range(1 + 7 * s % 41)]
    df = spark.createDataFrame([*rows, (None, 0, 0, 4.0), (None, 0, 1, 6.0)], "session_id long, field long, frame long, v double").repartition(5)
    spec = {"v": ("mean", "median", "p90", "std", "trend")}
    centred = TS.centered_features(df, spec, (15, 60))
    plan = centred._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and plan.count("Exchange hashpartitioning") == 1
    both = lambda: (sorted(map(str, centred.collect())), sorted(map(str, TS.sliding_features(df, spec, 20, 5).collect())))
    whole = both()
    asked = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(asked)
    spark.conf.set(asked, "3")  # sessions go on over many batches
    try:
        assert both() == whole
    finally:
        spark.conf.set(asked, before)
    got = {(r["session_id"], r["centre"]): r for r in centred.collect()}
    assert got[None, 0]["w15_v_mean"] == 5.0 and got[None, 0]["w15_v_trend"] is None
    assert len(got) == 1 + sum(-(-(1 + 7 * s % 41) // 8) for s in range(60))
    for (s, centre), r in got.items():
        own = [v for i, _, f, v in rows if i == s and centre - 7 <= f <= centre + 7 and v is not None]
        if s is not None:
            assert r["w15_v_median"] == (pytest.approx(np.median(own)) if own else None)
