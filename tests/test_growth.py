"""What is done once however large the tables are, seen by the plans, and that it
gives the same."""

import random

from pyspark.sql import functions as F

from kinetrail.operators import intervals, metrics, models, scans, timeseries
from kinetrail.plans import interval_queries, model_queries, registry, series_queries

from .oracle import connect

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_near_comes_with_the_episodes(spark):
    assert "sequence(start" not in plan_of(interval_queries.object_bouts(spark, SF))


def test_peaks_come_with_the_episodes(spark):
    assert "sequence(start" not in plan_of(series_queries.triage_episodes(spark, SF))


def test_greatest_values_of_runs_across_blocks(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.random() < 0.8, None if rng.random() < 0.2 else rng.random()) for s in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "session_id long, frame long, f boolean, v double")
    found = {(r.session_id, r.start, r.end): r.v for r in scans.flag_runs(df, "f", ["session_id"], block=16, most={"v": F.col("v")}).collect()}
    assert found
    for (s, start, end), most in found.items():
        own = [v for k, i, _, v in rows if k == s and start <= i <= end and v is not None]
        assert most == (max(own) if own else None)


def test_marks_are_not_repeated_or_broadcast_for_thresholds(spark):
    marked = spark.createDataFrame([(1, 0, 5), (1, 8, 20), (2, 3, 4)], "session_id long, start long, end long")
    found = spark.createDataFrame([(1, 0, 4, 9), (1, 1, 9, 9), (1, 1, 15, 30), (3, 0, 0, 7)], "session_id long, level int, start long, end long")
    out = metrics.threshold_counts(marked, found, [0.1, 0.2])
    assert "BroadcastHashJoin" not in plan_of(out)
    got = {(r.session_id, r.threshold): (r.manual, r.found, r.pairs, r.hits, r.real) for r in out.collect()}
    assert got == {
        (1, 0.1): (2, 1, 1, 2, 1), (1, 0.2): (2, 2, 1, 1, 2), (2, 0.1): (1, 0, 0, 0, 0), (2, 0.2): (1, 0, 0, 0, 0), (3, 0.1): (0, 1, 0, 0, 0),
    }


def test_groups_of_the_sql_do_not_overlap():
    """Episodes of both lanes with the same ends go to one group, in whatever
    order a sort leaves them."""
    text = registry.SQL["decision_groups"]
    con = connect("/root/testdata/sf0.1")
    con.execute(f"create table g as {text}")
    assert con.execute('select count(*) from g x join g y using (session_id) where x."start" < y."start" and y."start" <= x."end"').fetchone()[0] == 0


def test_training_rows_are_a_table(spark):
    text = plan_of(model_queries.training(spark, SF))
    assert "Window" not in text and "FileScan parquet" in text


def test_scores_of_windows_are_not_broadcast(spark):
    scores = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9), (2, 0, 0.5)], "session_id long, window long, score double")
    frames = spark.createDataFrame([(s, f, f) for s in (1, 2, 3) for f in range(20)], "session_id long, frame long, pos long")
    out = timeseries.nearest_window_score(frames, scores, 8, ["session_id"])
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.session_id, r.frame): r.score for r in out.collect()}
    assert got == {(1, f): 0.1 if f <= 4 else 0.9 for f in range(20)} | {(2, f): 0.5 for f in range(20)}


def test_context_is_fitted_on_tables(spark, monkeypatch):
    seen = []
    fit = models.fit_model

    def watched(df, *args, **options):
        seen.append(plan_of(df))
        return fit(df, *args, **options)

    monkeypatch.setattr(models, "fit_model", watched)
    rows = [(i % 4, i // 4, float(i % 7), i % 3 == 0, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "session_id long, window long, x double, y boolean, animal long")
    models.ContextModel.fit(df, ["x"], "y", "animal", ["session_id"], rounds=2)
    assert len(seen) == 6 and not any("Window" in text for text in seen)


def test_sustained_counts_runs(spark):
    rng = random.Random(3)
    rows = [(s, 3 * i, rng.choice([True, True, True, False, None])) for s in range(3) for i in range(150)]
    df = spark.createDataFrame(rows, "session_id long, frame long, f boolean")
    for least in (2, 3, 7):
        got = {(r.session_id, r.frame): r.s for r in intervals.sustained(df, "f", least, ["session_id"], "s").collect()}
        for s in range(3):
            flags, i = [bool(f) for k, _, f in rows if k == s], 0
            while i < len(flags):
                j = i
                while j < len(flags) and flags[j] == flags[i]:
                    j += 1
                assert all(got[s, 3 * k] == (flags[i] and j - i >= least) for k in range(i, j))
                i = j


def test_sustained_takes_no_maximum_of_rows_ahead(spark):
    df = spark.createDataFrame([(1, 0, True)], "session_id long, frame long, f boolean")
    assert "currentrow$(), 14" not in plan_of(intervals.sustained(df, "f", 15, ["session_id"], "s"))


def test_only_keys_are_counted_where_no_session_is_long(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(scans, "_block", lambda order, size: asked.append(order) or F.expr(f"{order} div {size}"))
    df = spark.createDataFrame([(1, i) for i in range(50)], "session_id long, frame long")
    assert scans.in_blocks(df, ["session_id"], 3, lambda d, keys: d, rows=1 << 14).count() == 50
    assert not asked
