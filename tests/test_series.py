"""Facts of kinematics, detectors, statistics and sampling."""

import itertools
import math

import numpy as np
import pytest

from kinetrail.functions import scalars
from kinetrail.functions.constants import KEYPOINTS
from kinetrail.operators import clips, detectors, models, sampling, statistics
from kinetrail.operators import timeseries as TS
from kinetrail.plans import registry
from kinetrail.sources import tables
from pyspark.sql import functions as F


def pose(spark, body, wob=None, p=None, fps=30):
    rows = []
    for i, (x, y) in enumerate(body):
        w = wob[i] if wob else 0
        at = {"nose": (x + w, y - 20), "ear_left": (x + w - 4, y - 10), "ear_right": (x + w + 4, y - 10), "neck": (x + w, y - 8), "body": (x, y), "tail_base": (x, y + 15)}
        rows.append(("S", 0, i, i * 1000.0 / fps, *(float(v) for k in KEYPOINTS for v in (*at[k], p[i] if p else 1.0))))
    cols = ", ".join(f"{k}_{a} double" for k in KEYPOINTS for a in "xyp")
    return spark.createDataFrame(rows, f"session_id string, field int, frame long, time_ms double, {cols}")


def circle(spark, *rows):
    return spark.createDataFrame([("S", i + 1, *map(float, r)) for i, r in enumerate(rows)], "session_id string, object_id int, center_x double, center_y double, radius double")


def test_speed_units(spark):
    df = TS.frame_kinematics(pose(spark, [(10 * i, 0) for i in range(4)]), fps=25).orderBy("frame").collect()
    assert df[0]["speed_body"] is None and df[1]["speed_body"] == pytest.approx(250)


def test_fps_must_be_positive(spark):
    with pytest.raises(ValueError):
        TS.frame_kinematics(pose(spark, [(0, 0)]), fps=0)


def test_freezing_and_walking(spark):
    still = [(100, 100)] * 60
    fast = [(100 + 2 * i, 100) for i in range(60)]
    df = detectors.detect_walking(detectors.detect_freezing(TS.frame_kinematics(pose(spark, still + fast)))).orderBy("frame").collect()
    assert all(r["freezing"] for r in df[5:50]) and all(r["walking"] for r in df[70:115])
    assert not any(r["freezing"] and r["walking"] for r in df)


def test_first_row_is_unscorable_and_review_never_lacks_a_pose(spark):
    df = TS.frame_kinematics(pose(spark, [(100, 100)] * 40, p=[0.0] * 10 + [1.0] * 30))
    rows = detectors.triage(df, circle(spark, (500, 500, 5))).orderBy("frame").collect()
    assert rows[0]["unscorable"] and all(r["unscorable"] for r in rows[:11])
    assert not any(r["unscorable"] and r["review"] for r in rows)


def test_object_needs_the_nose(spark):
    df = pose(spark, [(100, 60)] * 30)
    got = detectors.object_exploration(df, circle(spark, (100, 40, 15), (300, 40, 15)))
    assert {(r["object_id"], r["exploring"]) for r in got.collect()} == {(1, True), (2, False)}


def test_jumps_are_no_distance(spark):
    body = [(2 * i, 100) for i in range(40)] + [(500 + 2 * i, 100) for i in range(40)]
    layer = detectors.movement_layer(TS.frame_kinematics(pose(spark, body), distances=False), circle(spark, (900, 900, 5)))
    assert layer.agg(F.max("distance")).first()[0] < 170


def test_interpolation(spark):
    rows = [("S", 0, 0, 10.0, 100.0, 0.6, True), ("S", 0, 1, None, None, None, False), ("S", 0, 2, 20.0, 120.0, 0.8, True), ("S", 0, 3, None, None, None, False), ("S", 0, 4, -1.0, -1.0, 0.0, True), ("S", 0, 5, None, None, None, False)]
    df = spark.createDataFrame(rows, "session_id string, field int, frame long, k_x double, k_y double, k_p double, got boolean")
    out = [(r["k_x"], r["k_y"], r["k_p"]) for r in TS.interpolate_skipped(df, ["k"], "got").orderBy("frame").collect()]
    assert out[1] == pytest.approx((15, 110, 0.7)) and out[3] == (-1, -1, 0) and out[5] == (-1, -1, 0)


def test_trend(spark):
    df = spark.createDataFrame([("S", i, float(i)) for i in range(10)], "s string, i int, v double")
    out = TS.describe_window(df, ["s"], {"v": ("trend", "median", "std")}, F.col("i") >= 5).first()
    assert out["v_trend"] == 5 and out["v_median"] == 4.5


def test_short_session_is_one_window(spark):
    df = spark.createDataFrame([("S", 0, i, float(i)) for i in range(7)], "session_id string, field int, frame long, v double")
    out = TS.sliding_features(df, {"v": ("mean",)}, 20, 5).collect()
    assert len(out) == 1 and out[0]["v_mean"] == 3 and out[0]["centre"] == 3


def test_floor(spark):
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))))
    df = spark.createDataFrame([(5.0, 5.0), (-2.0, 5.0), (None, 1.0)], "x double, y double")
    got = [r[0] for r in df.select(scalars.floor_distance(F.col("x"), F.col("y"), square)).collect()]
    assert got == [5.0, -2.0, None]


def test_score_context(spark):
    df = spark.createDataFrame([("S", 0, i, 1.0 if i == 15 else 0.0) for i in range(30)], "session_id string, field int, window long, score double")
    rows = TS.score_context(df).orderBy("window").collect()
    assert [r["window"] for r in rows if r["ctx_max9"] == 1] == list(range(11, 20))


def test_t_distribution():
    assert statistics.t_cdf(2.228, 10) == pytest.approx(0.975, abs=1e-4)
    assert statistics.t_ppf(0.975, 5) == pytest.approx(2.5706, abs=1e-3)
    assert statistics.t_cdf(-1.0, 1) == pytest.approx(0.25)


def t_below(t: float, df: int) -> float:
    """The t distribution by summing its density."""
    x = np.linspace(0, abs(t), 200_001)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    half = float(np.sum((density[1:] + density[:-1]) / 2) * (x[1] - x[0])) if t else 0.0
    return 0.5 + math.copysign(half, t)


def signed_rank_p(d: list[float]) -> float:
    """Two-sided p by all signs; equal sizes share their mean rank."""
    sizes = [abs(x) for x in d]
    ranks = [sum(s < x for s in sizes) + (sum(s == x for s in sizes) + 1) / 2 for x in sizes]
    least = min(sum(r for r, x in zip(ranks, d) if x > 0), sum(r for r, x in zip(ranks, d) if x < 0))
    low = sum(sum(r for r, s in zip(ranks, signs) if s) <= least for signs in itertools.product((0, 1), repeat=len(d)))
    return min(1.0, 2 * low / 2 ** len(d))


@pytest.mark.parametrize("pairs", [
    [(10, 11), (20, 18), (31, 34), (40, 44), (52, 47), (60, 66), (71, 78), (80, 88)],
    [(5, 4), (9, 7), (14, 11), (20, 16), (27, 22), (35, 29), (44, 37)],
])
def test_p_values_of_paired_totals(spark, pairs):
    r = statistics.agreement(spark.createDataFrame([(float(m), float(a)) for m, a in pairs], "m double, a double"), "m", "a").first()
    m, d = np.array([p[0] for p in pairs], float), np.array([p[1] - p[0] for p in pairs], float)
    n, se, margin = len(d), d.std(ddof=1) / math.sqrt(len(d)), 0.15 * m.mean()
    assert r["paired_t_p"] == pytest.approx(2 * (1 - t_below(abs(d.mean() / se), n - 1)), abs=1e-7)
    assert r["tost_p"] == pytest.approx(max(1 - t_below((d.mean() + margin) / se, n - 1), t_below((d.mean() - margin) / se, n - 1)), abs=1e-7)
    assert r["wilcoxon_p"] == pytest.approx(signed_rank_p(list(d)), abs=1e-9)
    # the interval's ends are where the distribution has 2.5 and 97.5 %
    assert t_below((r["ci95_high"] - d.mean()) / se, n - 1) == pytest.approx(0.975, abs=1e-6)
    assert r["ci95_high"] - d.mean() == pytest.approx(d.mean() - r["ci95_low"])


def test_p_values_of_the_query(spark):
    from kinetrail.plans import metric_queries

    sf = "/root/testdata/sf0.001"
    p = metric_queries.paired(spark, sf).toPandas()
    d = (p["automatic"] - p["manual"]).to_numpy(float)
    r = registry.QUERIES["agreement"](spark, sf).first()
    se = d.std(ddof=1) / math.sqrt(len(d))
    assert r["n"] == len(d)
    assert r["paired_t_p"] == pytest.approx(2 * (1 - t_below(abs(d.mean() / se), len(d) - 1)), abs=1e-6)


def test_signed_ranks_in_ranges(spark, monkeypatch):
    values = [(float(i % 37 - 18), 0.0) for i in range(400)] + [(0.5 * i, 0.0) for i in range(-30, 50)]
    df = spark.createDataFrame(values, "m double, a double")
    got = []
    for ranges in (1, 7, 256):
        monkeypatch.setattr(statistics, "RANGES", ranges)
        got.append(statistics.signed_ranks(df, "m", "a").first())
    d = np.array([-m for m, _ in values if m])
    ranks = np.array([(abs(d) < x).sum() + ((abs(d) == x).sum() + 1) / 2 for x in abs(d)])
    assert got[0] == got[1] == got[2]
    assert got[0]["w_plus"] == ranks[d > 0].sum() and got[0]["w_minus"] == ranks[d < 0].sum() and got[0]["nonzero"] == len(d)
    none = statistics.signed_ranks(df.filter("m = 0"), "m", "a").first()
    assert (none["w_plus"], none["nonzero"], none["ties"]) == (0, 0, 0)


def test_mse_is_bias_and_spread(spark):
    df = spark.createDataFrame([(f"S{i}", 10.0 * i, 10.0 * i + i % 3) for i in range(1, 7)], "s string, m double, a double")
    r = statistics.total_error(df, "m", "a", "s").first()
    assert r["mse"] == pytest.approx(r["bias"] ** 2 + r["spread"])
    full = statistics.agreement(df, "m", "a").first()
    assert 0 < full["tost_p"] < 0.05 and 0 < full["paired_t_p"] < 1
    assert statistics.concordance(df, "m", "m").first()["ccc"] == 1


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 10) for i in range(50)], "session int, animal int")
    out = sampling.split_by_group(df, "animal")
    assert sampling.leakage_check(out, "animal").count() == 0
    assert {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count_distinct("animal").alias("n")).collect()} == {"train": 6, "validation": 2, "test": 2}
    assert sorted(out.collect()) == sorted(sampling.split_by_group(df, "animal").collect())
    with pytest.raises(ValueError):
        sampling.split_by_group(df, "animal", (0.5, 0.2, 0.2))


def test_surfacing(spark):
    frames = spark.createDataFrame([("S", i, float(i), i >= 18) for i in range(20)], "session_id string, frame long, score double, missing boolean")
    c = spark.createDataFrame([("c", "S", 0, 9), ("gone", "S", 16, 19)], "clip_id string, session_id string, start_frame long, end_frame long")
    got = {r["clip_id"]: r["score"] for r in clips.surfacing_score(frames, c, 0.2).collect()}
    assert got == {"c": 8.0, "gone": math.inf}


def test_contracts(spark):
    df = spark.createDataFrame([(0,), (0,)], "frame long")
    with pytest.raises(ValueError):
        tables.checked_features(df)
    with pytest.raises(ValueError):
        tables.require_columns(df, tables.LABELS)
    bad = spark.createDataFrame([("S", "A", 0, "flying", 0, 1, "x"), ("S", "A", 0, "rearing", 5, 1, "x"), ("S", "A", 0, "rearing", 0, 1, "x")], tables.LABELS)
    assert tables.label_violations(bad).count() == 2


def test_two_stages_need_two_groups(spark):
    df = spark.createDataFrame([("S", 0, 0.0, 1, True)], "session_id string, window long, f double, animal int, y boolean")
    with pytest.raises(ValueError):
        models.ContextModel.fit(df, ["f"], "y", "animal", ["session_id"])
