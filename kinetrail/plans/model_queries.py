"""Queries of splits, sampling and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detectors, intervals, models, sampling
from ..operators import timeseries as TS
from ..sources.scratch import written
from . import standins as S
from .registry import bout_list, query
from .series_queries import floors, triaged
from .table_queries import _shared

MAN = "select o_orderkey as session_id, o_custkey as animal_id from {t}"
OR = S.with_(mf=MAN.replace("{t}", "orders"))


def manifest(spark, sf) -> DataFrame:
    return spark.sql(MAN.replace("{t}", "{orders}"), orders=S.read(spark, sf, "orders"))


SPLIT = """(select animal_id, case when r<=t then 'train' when r<=t+v then 'validation' else 'test' end as split from (select animal_id, row_number() over (order by md5(cast(animal_id as varchar)||'|42')) as r,
    round_even(count(*) over ()*0.6e0, 0) as t, round_even(count(*) over ()*0.2e0, 0) as v from (select distinct animal_id from mf)))"""


@query(OR + f"select session_id, animal_id, split from mf join {SPLIT} using (animal_id)")
def split_by_group(spark, sf):
    return sampling.split_by_group(manifest(spark, sf), "animal_id").select("session_id", "animal_id", "split")


@query(OR + "select animal_id from (select animal_id, count(distinct session_id%3) as n from mf group by 1) where n>1")
def leakage_check(spark, sf):
    df = manifest(spark, sf).withColumn("split", F.col("session_id") % 3)
    return sampling.leakage_check(df, "animal_id")


FOLD = """(select animal_id, (row_number() over (partition by c order by md5(cast(animal_id as varchar)||'|0')) - 1 + c) % 5 as fold from (select animal_id, (avg((session_id%3=0)::int)>=0.5)::int as c from mf group by 1))"""


@query(OR + f"select session_id, animal_id, cast(fold as bigint) as fold from mf join {FOLD} using (animal_id)")
def group_folds(spark, sf):
    df = manifest(spark, sf).withColumn("y", F.col("session_id") % 3 == 0)
    return sampling.group_folds(df, "animal_id", 5, 0, "y").select("session_id", "animal_id", F.col("fold").cast("long").alias("fold"))


M = S.with_(m=S.MASKS_SQL)


def tiles_sql(flag: str, length: int) -> str:
    return f"""(select session_id, "start" as run_start, "start"+k*{length} as s, "start"+k*{length}+{length - 1} as e from {bout_list('m', flag)} cross join (select unnest(range(0, 40)) as k) where k < ("end"-"start"+1)//{length})"""


def first_tiles(flag: str, length: int) -> str:
    return f"""(select session_id, s, e, h from (select *, row_number() over (partition by session_id, run_start order by h) as r from (select *, md5(concat(cast(session_id as varchar), ':', cast(s as varchar), '|3')) as h from {tiles_sql(flag, length)})) where r=1)"""


@query(M + f'select session_id, s as "start", e as "end" from {first_tiles("b", 5)} order by h limit 300')
def sample_runs(spark, sf):
    return sampling.sample_runs(S.masks(spark, sf), "b", 5, 300, ["session_id"], 3)


@query(M + f"""select session_id, s as "start", e as "end" from {first_tiles("b", 5)} t where not exists (select 1 from {bout_list('m', 'a')} x where x.session_id=t.session_id and x."start"<=t.e+2 and t.s-2<=x."end" and x."start"%4=0)""")
def exclude_overlaps(spark, sf):
    m = S.masks(spark, sf)
    clips = sampling.sample_runs(m, "b", 5, None, ["session_id"], 3)
    return sampling.exclude_overlaps(clips, intervals.bouts(m, "a", ["session_id"]).filter("start % 4 = 0"), ["session_id"], 2)


#: Strata whose runs overlap, and what holds in them.
STRATA = {"a": "a", "b": "b", "freezing": "freezing", "idle": "not a and not b", "high": "score >= 0.5e0"}
CAND = "cd as (" + " union all ".join(
    f"select '{n}' as stratum, session_id, s, e, md5(concat('{n}', ':', cast(session_id as varchar), ':', cast(s as varchar), '|3')) as h from {tiles_sql(flag, 5)}" for n, flag in STRATA.items()) + ")"
TAKE = """{n}o as (select *, row_number() over (partition by session_id order by h) as k from cd where stratum='{n}' {not_}),
  {n}w as (select session_id, k, s, e, h, [s] as used, true as ok from {n}o where k=1 union all select p.session_id, p.k, p.s, p.e, p.h, case when p.ok2 then list_append(w.used, p.s) else w.used end, p.ok2 from {n}w w join lateral
    (select *, len([u for u in w.used if abs(u-s)<5])=0 as ok2 from {n}o where {n}o.session_id=w.session_id and {n}o.k=w.k+1) p on true),
  {n}_taken as (select session_id, '{n}' as stratum, s, e from {n}w where ok order by h limit 200)"""


def _clear_of(names) -> str:
    return " ".join(f"and not exists (select 1 from {n}_taken x where x.session_id=cd.session_id and x.s<=cd.e and cd.s<=x.e)" for n in names)


@query("with recursive m as (" + S.MASKS_SQL + "), " + CAND + ", " + ", ".join(TAKE.format(n=n, not_=_clear_of(list(STRATA)[:i])) for i, n in enumerate(STRATA))
    + " " + " union all ".join(f'select session_id, stratum, s as "start", e as "end" from {n}_taken' for n in STRATA))
def stratified_clips(spark, sf):
    # read once per stratum
    m, parts = written(S.masks(spark, sf).select("session_id", "frame", *(F.expr(flag).alias(f"_in_{n}") for n, flag in STRATA.items())), "strata"), None
    for stratum in STRATA:
        one = sampling._tiles(m, f"_in_{stratum}", 5, ["session_id"]).select("session_id", F.lit(stratum).alias("stratum"), "start", "end")
        parts = one if parts is None else parts.unionByName(one)
    return sampling.stratified_clips(parts, list(STRATA), 200, ["session_id"], 3)


OFFSET = "cast(('0x' || substr(md5(concat(cast(session_id as varchar), '|0')), 1, 8)) as bigint) % 30"


TILES = f"""select concat(cast(session_id as varchar), '_', cast(o+30*k as varchar)) as clip_id, session_id, o+30*k as start_frame, o+30*k+29 as end_frame from
    (select *, unnest(range(0, n//30+1)) as k from (select session_id, {OFFSET} as o, count(*) as n from m group by session_id)) where o+30*k+30 <= n"""
SHOWN = """select t.*, sc[k] as score from tl t join (select clip_id, avg(missing::int) as gone, cast(ceil(0.1*count(*)-1e-9) as int) as k, list(score order by score desc) filter (not missing) as sc
    from tl c join m on m.session_id=c.session_id and m.rn between c.start_frame and c.end_frame group by 1) using (clip_id) where gone<0.1 and len(sc)>=k"""
BAND = """select *, (score>=c1)::int + (score>=c2)::int as band from sh cross join (select quantile_cont(v, 0.5) as c1, quantile_cont(v, 0.8) as c2 from (select case when missing then 'inf'::double else score end as v from m))"""


@query(S.with_(m=S.MASKS_SQL, tl=TILES, sh=SHOWN, bd=BAND) + """select clip_id, session_id, start_frame, end_frame, ['band_00_50', 'band_50_80', 'band_80_100'][band+1] as triage_label, round(score, 6) as score, round(share, 6) as band_share from (
    select *, count(*) over (partition by band)/count(*) over () as share, row_number() over (partition by band order by md5(concat(clip_id, '|0'))) as r from bd) where r<=40""")
def score_band_clips(spark, sf):
    """40 tiles of every score band, with the band's share of all tiles."""
    frames = S.masks(spark, sf).select("session_id", F.col("rn").alias("frame"), "score", "missing")
    out = sampling.score_band_clips(frames, [0.5, 0.8], 30, 40, ["session_id"])
    return out.withColumn("score", F.round("score", 6)).withColumn("band_share", F.round("band_share", 6))


@query(M + f"select concat(cast(session_id as varchar), '_', cast(start_frame as varchar)) as clip_id, session_id, start_frame, end_frame from ({TILES})")
def tile_sessions(spark, sf):
    """Whole tiles of every session from a hashed offset."""
    return sampling.tile_sessions(S.masks(spark, sf), 30, ["session_id"])


# --- models ----------------------------------------------------------------
FEATURES = ["f0", "f1", "f2"]


def training(spark, sf) -> DataFrame:
    """Windows with three features, one with gaps, a label and an animal, as a table:
    a fit reads it many times."""
    m = S.masks(spark, sf).filter("rn % 8 = 0")
    rows = m.select(
        "session_id", F.expr("rn div 8").alias("window"), F.col("score").alias("f0"), F.when(F.col("missing"), F.lit(None)).otherwise(F.col("rn") % 17 / 17).alias("f1"),
        F.col("a").cast("double").alias("f2"), (F.col("score") + F.col("rn") % 5 / 20 > 0.6).alias("y"), (F.col("session_id") % 4).alias("animal"),
    )
    return written(rows, "training")


@query()
def fit_model(spark, sf):
    df = training(spark, sf)
    return models.score(models.fit_model(df, FEATURES, "y"), df, FEATURES).select("session_id", "window", "y", "score")


@query()
def score_session(spark, sf):
    df = training(spark, sf)
    model = models.fit_model(df, FEATURES, "y", balanced=True)
    frames = S.masks(spark, sf).select("session_id", "frame", F.col("rn").alias("pos"))
    return models.score_session(model, df, frames, FEATURES, ["session_id"]).select("session_id", "frame", "score")


@query()
def context_model(spark, sf):
    df = training(spark, sf)
    fitted = models.ContextModel.fit(df, FEATURES, "y", "animal", ["session_id"])
    return fitted.score(df, ["session_id"]).select("session_id", "window", "y", "score")


@query()
def cross_validate(spark, sf):
    return models.cross_validate(training(spark, sf), FEATURES, "y", "animal").select("session_id", "window", "y", "score")


@query()
def leave_one_group_out(spark, sf):
    return models.leave_one_group_out(training(spark, sf), FEATURES, "y", "animal").select("session_id", "window", "animal", "y", "score")


@query()
def save_model(spark, sf):
    df, path = training(spark, sf), _shared(spark, "model")
    models.save_model(models.fit_model(df, FEATURES, "y"), path, spark, FEATURES, 0.4, ["S1"])
    model, _ = models.load_model(path, spark, FEATURES)
    return models.score(model, df, FEATURES).select("session_id", "window", "score")


@query()
def detect(spark, sf):
    """Stored model and threshold to gated episodes."""
    df = training(spark, sf)
    frames = S.masks(spark, sf).select("session_id", "frame", "freezing", F.col("rn").alias("pos"))
    scored = models.score_session(models.fit_model(df, FEATURES, "y"), df, frames, FEATURES, ["session_id"])
    masked = detectors.frame_mask(scored, "score", 0.5, "m", keys=["session_id"])
    gated = detectors.gate(masked, "m", "rearing", "g", keys=["session_id"])
    return intervals.bouts(gated, "g", ["session_id"])


@query()
def prepare_session(spark, sf):
    """Pose to window features over all sessions, in one plan."""
    own = TS.frame_signals(TS.with_rules(triaged(spark, sf)), S.objects(spark, sf))
    df = TS.dwell_signals(own)
    return TS.centered_features(df, TS.spec_of(df.columns))


@query()
def session_features(spark, sf):
    """The same with marked floors in place of the percentile rectangle and the
    head's rise over the body."""
    own = TS.frame_signals(TS.with_rules(triaged(spark, sf)), S.objects(spark, sf))
    df = TS.dwell_signals(TS.pose_rise(TS.with_floor(own, floors(spark, sf))))
    return TS.centered_features(df, TS.spec_of(df.columns))
