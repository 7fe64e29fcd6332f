"""Queries cover their whole input, at the operators' own settings."""

import inspect

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 registers the queries
from kinetrail.operators import clips, models
from kinetrail.plans import registry
from kinetrail.plans import standins as S
from kinetrail.sources import tables as TB

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("cut", ["% 25", "rn<400", "limit 10"])
def test_sql_reads_whole_tables(cut):
    assert not [n for n, text in registry.SQL.items() if cut in text]


def test_session_ids_from_folders_and_files(spark, tmp_path):
    ids = ["001", "S1", "a b+c:d%e"]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(ids)], "session_id string, frame long")
    df.write.partitionBy("session_id").csv(str(tmp_path / "folders"), header=True)
    got = TB.read_sessions(spark, str(tmp_path / "folders"), TB.struct("frame long")).collect()
    assert sorted((r["session_id"], r["frame"]) for r in got) == [(s, i) for i, s in enumerate(ids)]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "HD1_F2.csv").write_text("frame\n7\n")
    got = TB.read_sessions(spark, str(tmp_path / "files"), TB.struct("frame long")).collect()
    assert [tuple(r) for r in got] == [("HD1_F2", 7)]


def test_clips_reach_the_last_rows(spark):
    ends = S.clips(spark, SF).groupBy("session_id").agg(F.max("start_frame").alias("s"), F.count(F.lit(1)).alias("n"))
    rows_of = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("session_id")).agg(F.count(F.lit(1)).alias("r"))
    got = ends.join(rows_of, "session_id").collect()
    assert len(got) == rows_of.count() and all(r["n"] == -(-r["r"] // 40) and r["r"] - r["s"] <= 40 for r in got)


class Seen(Exception):
    """Carries what a query asked for; nothing is fitted."""


@pytest.mark.parametrize("name", ["fit_model", "score_session", "context_model", "cross_validate", "leave_one_group_out", "save_model", "detect"])
def test_models_have_all_rounds(spark, monkeypatch, name):
    def trees(**options):
        raise Seen(options["maxIter"])

    monkeypatch.setattr(models, "GBTClassifier", trees)
    with pytest.raises(Seen, match="^150$"):
        registry.QUERIES[name](spark, SF)


@pytest.mark.parametrize(("name", "folds"), [("cross_validate", 5), ("context_model", 4)])  # there are four animals
def test_models_have_all_folds(spark, monkeypatch, name, folds):
    def out_of_fold(df, features, label, n, *rest, **options):
        raise Seen(n)

    monkeypatch.setattr(models, "_out_of_fold", out_of_fold)
    with pytest.raises(Seen, match=f"^{folds}$"):
        registry.QUERIES[name](spark, SF)


@pytest.mark.parametrize("name", ["prepare_session", "session_features"])
def test_sessions_have_all_windows(spark, name):
    columns = registry.QUERIES[name](spark, SF).columns
    assert all(any(c.startswith(f"w{size}_") for c in columns) for size in (15, 60, 120, 300))


def test_bootstrap_has_all_resamples(spark, monkeypatch):
    def escape(evaluated, weights, reps=inspect.signature(clips.bootstrap_escape).parameters["reps"].default):
        raise Seen(reps)

    monkeypatch.setattr(clips, "bootstrap_escape", escape)
    with pytest.raises(Seen, match="^2000$"):
        registry.QUERIES["bootstrap_ci"](spark, SF)
