"""Queries of time series, signals, detectors and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.constants import KEYPOINTS
from ..operators import detectors as D
from ..operators import intervals, metrics, scans
from ..operators import timeseries as TS
from ..sources.scratch import written
from . import standins as S
from .registry import bout_list, filled, median, query, runs, sustain

K2 = ["session_id", "field"]
KS = "session_id, field"
P = S.with_(pose=S.POSE_SQL)
KIN = S.with_(pose=S.POSE_SQL, kin=S.kin_sql())


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def rsql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


def kin(spark, sf) -> DataFrame:
    return TS.frame_kinematics(S.pose(spark, sf))


@query(P + "select session_id, frame, case when nose_p>=0.25 then nose_x end as x, case when nose_p>=0.25 then nose_y end as y from pose")
def confidence_mask(spark, sf):
    return S.pose(spark, sf).select("session_id", "frame", scalars.confident("nose_x", "nose_p").alias("x"), scalars.confident("nose_y", "nose_p").alias("y"))


@query(P + f"select session_id, frame, {rsql('nose_x-(ear_left_x+ear_right_x)/2', 'nose_y-(ear_left_y+ear_right_y)/2').replace('as nose_x-(ear_left_x+ear_right_x)/2', 'as dx').replace('as nose_y-(ear_left_y+ear_right_y)/2', 'as dy')} from pose")
def head_direction(spark, sf):
    dx, dy = scalars.head_direction()
    return S.pose(spark, sf).select("session_id", "frame", F.round(dx, 6).alias("dx"), F.round(dy, 6).alias("dy"))


@query(P + "select session_id, frame, round(sqrt((nose_x-body_x)*(nose_x-body_x)+(nose_y-body_y)*(nose_y-body_y)), 6) as dist_nose_body, round(sqrt((neck_x-tail_base_x)*(neck_x-tail_base_x)+(neck_y-tail_base_y)*(neck_y-tail_base_y)), 6) as dist_neck_tail_base from pose")
def point_distance(spark, sf):
    d = scalars.point_distances(KEYPOINTS)
    return S.pose(spark, sf).select("session_id", "frame", *(F.round(d[n], 6).alias(n) for n in ("dist_nose_body", "dist_neck_tail_base")))


@query(KIN + f"select session_id, frame, {rsql('posx_nose', 'posy_nose', 'speed_nose', 'speed_body', 'speed_neck')} from kin")
def frame_kinematics(spark, sf):
    return kin(spark, sf).select("session_id", "frame", *r6("posx_nose", "posy_nose", "speed_nose", "speed_body", "speed_neck"))


def _w(rows: int) -> str:
    return f"over (partition by {KS} order by frame rows between {rows // 2} preceding and {(rows - 1) // 2} following)"


@query(KIN + "select session_id, frame, " + ", ".join(f"round({f}(speed_body) {_w(r)}, 6) as speed_body_w{r}_{n}" for r in (6, 12, 30, 60) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " from kin")
def window_features(spark, sf):
    df = TS.window_features(kin(spark, sf), ["speed_body"], (0.2, 0.4, 1.0, 2.0))
    return df.select("session_id", "frame", *r6(*(c for c in df.columns if c.startswith("speed_body_w"))))


@query(KIN + f"select session_id, frame, round({median('speed_body', 9)}, 6) as smooth from kin")
def smooth_median(spark, sf):
    return kin(spark, sf).select("session_id", "frame", F.round(TS.smooth("speed_body", 9), 6).alias("smooth"))


STRAIGHT = f"""(select *, case when path > 0 then sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))/path end as straight from (
    select *, case when count(step) {_w(31)} >= 15 then sum(step) {_w(31)} end as path, lead(posx_body, 15) over w as x2, lag(posx_body, 15) over w as x1,
      lead(posy_body, 15) over w as y2, lag(posy_body, 15) over w as y1 from (
      select *, sqrt((posx_body-lag(posx_body) over v)*(posx_body-lag(posx_body) over v)+(posy_body-lag(posy_body) over v)*(posy_body-lag(posy_body) over v)) as step
      from kin window v as (partition by {KS} order by frame)) window w as (partition by {KS} order by frame)))"""


@query(KIN + f"select session_id, frame, round(straight, 6) as straight from {STRAIGHT}")
def path_straightness(spark, sf):
    df = kin(spark, sf).withColumn("_step", TS.moved("posx_body", "posy_body"))
    return df.select("session_id", "frame", F.round(TS.path_straightness("posx_body", "posy_body"), 6).alias("straight"))


SKIP = "select *, rn % 4 = 0 or rn % 7 = 0 as inferred from pose"
_INT = """case when inferred then body_{a} when b_frame is null then a_{a} when a_frame is null then {lost} when a_p>=0.25 and b_p>=0.25
    then a_{a} + (frame-a_frame)*1e0/(b_frame-a_frame)*(b_{a}-a_{a}) else {lost} end"""


@query(S.with_(pose=S.POSE_SQL, skip=SKIP, both_="""select *, """ + ", ".join(
    f"last_value(case when inferred then {c} end ignore nulls) over (partition by {KS} order by frame rows between unbounded preceding and current row) as a_{n}, "
    f"first_value(case when inferred then {c} end ignore nulls) over (partition by {KS} order by frame rows between current row and unbounded following) as b_{n}"
    for n, c in (("frame", "frame"), ("x", "body_x"), ("y", "body_y"), ("p", "body_p"))) + " from skip")
    + "select session_id, frame, " + ", ".join(f"round({_INT.format(a=a, lost=lost)}, 6) as body_{a}" for a, lost in (("x", "-1e0"), ("y", "-1e0"), ("p", "0e0"))) + " from both_")
def interpolate_skipped(spark, sf):
    df = S.pose(spark, sf).withColumn("inferred", F.expr("rn % 4 = 0 or rn % 7 = 0"))
    return TS.interpolate_skipped(df, ["body"], "inferred").select("session_id", "frame", *r6("body_x", "body_y", "body_p"))


@query(KIN + f"select session_id, frame, case when m>0 then round(speed_body/m, 6) end as speed_body from kin join (select {KS}, quantile_cont(speed_body, 0.5) as m from kin group by all) using ({KS})")
def relative_to_session(spark, sf):
    return TS.relative_to_session(kin(spark, sf), ["speed_body"]).select("session_id", "frame", *r6("speed_body"))


OBJ_SQL = f"""(select p.*, coalesce(d, case when exists (select 1 from objects o where o.session_id=p.session_id) then null else 1000e0 end) as object_distance from kin p left join (
    select k.session_id, k.frame, min(sqrt((o.center_x-posx_nose)*(o.center_x-posx_nose)+(o.center_y-posy_nose)*(o.center_y-posy_nose))-o.radius) as d
    from kin k join objects o on o.session_id=k.session_id group by all) x on x.session_id=p.session_id and x.frame=p.frame)"""
BOX_SQL = """(select session_id, quantile_cont(posx_body, 0.01) as bx1, quantile_cont(posx_body, 0.99) as bx2, quantile_cont(posy_body, 0.01) as by1, quantile_cont(posy_body, 0.99) as by2 from kin group by 1)"""
SIGNALS = ("body_speed", "typical_speed", "head_speed", "nose_speed", "bend", "straightness", "body_length", "object_distance", "wall_distance")
_SP = "[" + ", ".join(f"speed_{k}" for k in KEYPOINTS) + "]"
SIGNAL_SQL = f"""(select s.session_id, s.field, s.rn, s.frame, speed_body as body_speed, list_median({_SP}) as typical_speed,
    30*sqrt((hx-lag(hx) over w)*(hx-lag(hx) over w)+(hy-lag(hy) over w)*(hy-lag(hy) over w)) as head_speed,
    30*sqrt((nx-lag(nx) over w)*(nx-lag(nx) over w)+(ny-lag(ny) over w)*(ny-lag(ny) over w)) as nose_speed,
    degrees(abs(atan2((posx_body-posx_tail_base)*hy-(posy_body-posy_tail_base)*hx, (posx_body-posx_tail_base)*hx+(posy_body-posy_tail_base)*hy))) as bend,
    straight as straightness, len_/quantile_cont(len_, 0.5) over (partition by s.session_id) as body_length, object_distance,
    case when posx_neck is not null and posy_neck is not null then least(posx_neck-bx1, bx2-posx_neck, posy_neck-by1, by2-posy_neck) end as wall_distance
    from (select *, posx_neck-posx_body as hx, posy_neck-posy_body as hy, posx_nose-posx_neck as nx, posy_nose-posy_neck as ny,
      sqrt((posx_neck-posx_tail_base)*(posx_neck-posx_tail_base)+(posy_neck-posy_tail_base)*(posy_neck-posy_tail_base)) as len_ from {STRAIGHT}) s
    join (select session_id, frame, object_distance from {OBJ_SQL}) o on o.session_id=s.session_id and o.frame=s.frame join {BOX_SQL} b on b.session_id=s.session_id
    window w as (partition by s.session_id, s.field order by s.frame))"""
SIG = S.with_(pose=S.POSE_SQL, objects=S.OBJECTS_SQL, kin=S.kin_sql(), sig=SIGNAL_SQL)


def signals(spark, sf) -> DataFrame:
    return TS.frame_signals(kin(spark, sf), S.objects(spark, sf))


@query(SIG + f"select session_id, frame, {rsql(*SIGNALS)} from sig")
def frame_signals(spark, sf):
    return signals(spark, sf).select("session_id", "frame", *r6(*SIGNALS))


FLOOR = "select s_suppkey as session_id, 45e0 as ax, 40e0+s_suppkey%100-25 as ay, 190e0 as bx, 35e0+s_suppkey%100-20 as by_, 185e0 as cx, 75e0+s_suppkey%100 as cy, 50e0 as dx, 70e0+s_suppkey%100 as dy from {supplier}"


def floors(spark, sf) -> DataFrame:
    f = spark.sql(FLOOR, supplier=S.read(spark, sf, "supplier"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return f.select("session_id", F.array(point("ax", "ay"), point("bx", "by_"), point("cx", "cy"), point("dx", "dy")).alias("polygon"))


def _sides() -> list[tuple[str, str, str, str]]:
    c = [("ax", "ay"), ("bx", "by_"), ("cx", "cy"), ("dx", "dy")]
    return [(*c[i], *c[(i + 1) % 4]) for i in range(4)]


def inside_sql(x: str, y: str) -> str:
    hits = [f"case when (({ay}>{y})<>({by}>{y})) and {x} < ({bx}-{ax})*({y}-{ay})/({by}-{ay})+{ax} then 1 else 0 end" for ax, ay, bx, by in _sides()]
    return "((" + "+".join(hits) + ") % 2 = 1)"


def floor_sql(x: str, y: str) -> str:
    parts = []
    for ax, ay, bx, by in _sides():
        ux, uy = f"({bx}-{ax})", f"({by}-{ay})"
        t = f"greatest(0e0, least(1e0, (({x}-{ax})*{ux}+({y}-{ay})*{uy})/({ux}*{ux}+{uy}*{uy})))"
        parts.append(f"sqrt(({x}-({ax}+{t}*{ux}))*({x}-({ax}+{t}*{ux}))+({y}-({ay}+{t}*{uy}))*({y}-({ay}+{t}*{uy})))")
    near = f"least({', '.join(parts)})"
    return f"case when {x} is not null and {y} is not null then case when {inside_sql(x, y)} then {near} else -{near} end end"


FL = S.with_(pose=S.POSE_SQL, kin=S.kin_sql(), fl=FLOOR.replace("{supplier}", "supplier"))


@query(FL + f"select session_id, frame, round({floor_sql('posx_nose', 'posy_nose')}, 6) as d from kin join fl using (session_id)")
def floor_distance(spark, sf):
    df = kin(spark, sf).join(floors(spark, sf), "session_id")
    return df.select("session_id", "frame", F.round(scalars.floor_distance(F.col("posx_nose"), F.col("posy_nose"), F.col("polygon")), 6).alias("d"))


@query(FL + f"select session_id, frame, coalesce({inside_sql('posx_nose', 'posy_nose')}, false) as inside from kin join fl using (session_id)")
def point_in_polygon(spark, sf):
    df = kin(spark, sf).join(floors(spark, sf), "session_id")
    return df.select("session_id", "frame", scalars.in_polygon(F.col("posx_nose"), F.col("posy_nose"), F.col("polygon")).alias("inside"))


@query(FL + f"select session_id, frame, round({floor_sql('posx_neck', 'posy_neck')}, 6) as wall_distance, round({floor_sql('posx_nose', 'posy_nose')}, 6) as nose_floor from kin join fl using (session_id)")
def with_floor(spark, sf):
    return TS.with_floor(kin(spark, sf), floors(spark, sf)).select("session_id", "frame", *r6("wall_distance", "nose_floor"))


_W150 = _w(150)
@query(KIN + f"""select session_id, frame, round((posy_neck-posy_body)/t, 6) as neck_rel_y, round((posy_nose-posy_body)/t, 6) as nose_rel_y,
    round(len_/case when count(len_) {_W150} >= 30 then quantile_cont(len_, 0.5) {_W150} end, 6) as length_local from (
      select *, quantile_cont(len_, 0.5) over (partition by {KS}) as t from (
        select *, sqrt((posx_neck-posx_tail_base)*(posx_neck-posx_tail_base)+(posy_neck-posy_tail_base)*(posy_neck-posy_tail_base)) as len_ from kin))""")
def pose_rise(spark, sf):
    return TS.pose_rise(kin(spark, sf)).select("session_id", "frame", *r6("neck_rel_y", "nose_rel_y", "length_local"))


def _held(flag: str, out: str) -> str:
    """SQL: seconds that a flag of d has held."""
    return f"""(select session_id, frame, case when _f then round(least(row_number() over (partition by {KS}, _r order by frame)/30e0, 60e0), 6) else 0e0 end as {out}
      from {runs('d', flag, KS)})"""


@query(S.with_(pose=S.POSE_SQL, objects=S.OBJECTS_SQL, kin=S.kin_sql(), sig=SIGNAL_SQL, d=f"select *, not (coalesce({median('body_speed', 15)}, 0) > 17) as still, coalesce(wall_distance < 25, false) as wall from sig")
    + f"select a.session_id, a.frame, still_sec, wall_sec from {_held('still', 'still_sec')} a join {_held('wall', 'wall_sec')} b on a.session_id=b.session_id and a.frame=b.frame")
def dwell_signals(spark, sf):
    return TS.dwell_signals(signals(spark, sf)).select("session_id", "frame", *r6("still_sec", "wall_sec"))


SPEC = {"body_speed": ("mean", "median", "p10", "p90", "std", "trend"), "wall_distance": ("median", "p90")}


def stats_sql(late: str, spec: dict[str, tuple[str, ...]] = SPEC, prefix: str = "") -> str:
    f = {"mean": "avg({v})", "median": "quantile_cont({v}, 0.5)", "p10": "quantile_cont({v}, 0.1)", "p90": "quantile_cont({v}, 0.9)", "std": "stddev_pop({v})",
         "trend": "avg(case when {l} then {v} end) - avg(case when not {l} then {v} end)"}
    return ", ".join(f"round({f[s].format(v=v, l=late)}, 6) as {prefix}{v}_{s}" for v, stats in spec.items() for s in stats)


STATS = [f"{v}_{s}" for v, stats in SPEC.items() for s in stats]


@query(SIG + f"select session_id, cast(floor(rn/60e0) as bigint) as block, {stats_sql('(rn%60>=30)')} from sig group by 1, 2")
def describe_window(spark, sf):
    df = signals(spark, sf).withColumn("block", F.expr("rn div 60")).withColumn("late", F.expr("rn % 60 >= 30"))
    out = TS.describe_window(df, ["session_id", "block"], SPEC, F.col("late"))
    return out.select("session_id", "block", *r6(*STATS))


#: Every signal that SQL gives, with its own statistics.
FULL = TS.spec_of(SIGNALS)


def _centred_sql(size: int) -> str:
    return f"""(select c.session_id, c.rn as centre, {stats_sql(f'(s.rn >= c.rn - {size // 2} + {size // 2})', FULL, f'w{size}_')} from (select session_id, rn from sig where rn%8=0) c join sig s on s.session_id=c.session_id
      and s.rn between c.rn-{size // 2} and c.rn-{size // 2}+{size - 1} group by 1, 2)"""


@query(SIG.replace("sig as (", "sig as materialized (") + "select * from " + _centred_sql(15) + "".join(f" join {_centred_sql(size)} using (session_id, centre)" for size in (60, 120, 300)))
def centered_features(spark, sf):
    df = TS.centered_features(signals(spark, sf), FULL)
    return df.select("session_id", "centre", *r6(*(c for c in df.columns if c[0] == "w")))


@query(SIG + f"""select c.session_id, c.rn as "start", c.rn+29.5e0 as centre, {stats_sql('(s.rn >= c.rn + 30)')} from (select session_id, rn from sig where rn%15=0) c join sig s on s.session_id=c.session_id and s.rn between c.rn and c.rn+59
    where c.rn+59 <= (select max(rn) from sig m where m.session_id=c.session_id) group by all""")
def sliding_features(spark, sf):
    df = TS.sliding_features(signals(spark, sf), SPEC, 60, 15)
    return df.select("session_id", "start", "centre", *r6(*STATS))


@query("with clips as (" + S.CLIPS_SQL + "), " + SIG[5:] + f"select c.clip_id, {stats_sql('false').replace('avg(case when false then body_speed end) - avg(case when not false then body_speed end)', 'avg(body_speed)')} from clips c join sig s on s.session_id=c.session_id and s.frame between c.start_frame and c.end_frame group by 1")
def clip_features(spark, sf):
    spans = intervals.range_join(signals(spark, sf), S.clips(spark, sf).select("clip_id", "session_id", "start_frame", "end_frame"), ["session_id"])
    spec = {k: tuple("mean" if s == "trend" else s for s in v) for k, v in SPEC.items()}
    spec["body_speed"] = ("mean", "median", "p10", "p90", "std")
    out = TS.describe_window(spans, ["clip_id"], spec).withColumn("body_speed_trend", F.col("body_speed_mean"))
    return out.select("clip_id", *r6(*STATS))


M = S.with_(m=S.MASKS_SQL)
WIN = "(select session_id, cast(rn/8 as bigint) as win, score from m where rn%8=0)"


def windows(spark, sf) -> DataFrame:
    return S.masks(spark, sf).filter("rn % 8 = 0").select("session_id", F.expr("rn div 8").alias("window"), "score")


@query(M + f"select m.session_id, m.frame, round(s.score, 6) as score from m join (select session_id, max(win) as most from {WIN} group by 1) x using (session_id) join {WIN} s on s.session_id=m.session_id and s.win=greatest(0, least(cast(round_even(m.rn/8e0, 0) as bigint), most))")
def nearest_window_score(spark, sf):
    frames = S.masks(spark, sf).select("session_id", "frame", F.col("rn").alias("pos"))
    return TS.nearest_window_score(frames, windows(spark, sf), 8, ["session_id"]).select("session_id", "frame", *r6("score"))


_CTX = "over (partition by session_id order by win{})"
@query(M + "select session_id, win, round(score, 6) as ctx_self, " + ", ".join(f"round(lag(score, {k}) {_CTX.format('')}, 6) as ctx_prev{k}, round(lead(score, {k}) {_CTX.format('')}, 6) as ctx_next{k}" for k in (1, 2, 3, 4, 6, 8, 12))
    + ", " + ", ".join(f"round(max(score) {_CTX.format(f' rows between {n // 2} preceding and {n // 2} following')}, 6) as ctx_max{n}, round(avg(score) {_CTX.format(f' rows between {n // 2} preceding and {n // 2} following')}, 6) as ctx_mean{n}" for n in (9, 25)) + f" from {WIN}")
def score_context(spark, sf):
    df = TS.score_context(windows(spark, sf), ["session_id"]).withColumnRenamed("window", "win")
    return df.select("session_id", "win", *r6(*(c for c in df.columns if c.startswith("ctx_"))))


_SEEN = "(" + "+".join(f"case when {k}_p>=0.25 then 1 else 0 end" for k in KEYPOINTS) + ")>=3"


ARRIVAL = f"""select s.session_id, coalesce(b.first, 0) as arrival from (select distinct session_id from pose) s left join (
    select session_id, min("start") as first from {bout_list('pose', _SEEN, KS)} where "end"-"start"+1>=30 group by 1) b using (session_id)"""


def arrived(spark, sf) -> DataFrame:
    seen = sum((F.when(F.col(f"{k}_p") >= 0.25, 1).otherwise(0) for k in KEYPOINTS), F.lit(0)) >= 3
    return intervals.first_long_bout(S.pose(spark, sf).withColumn("_seen", seen), "_seen", 30, K2, "arrival").drop("field")


@query(P + ARRIVAL)
def arrival(spark, sf):
    """First row of the first second with three confident keypoints."""
    return arrived(spark, sf)


# --- detectors -------------------------------------------------------------
VALID = "coalesce(" + ", ".join(f"speed_{k}" for k in KEYPOINTS) + ") is not null"
FREEZE = sustain(f"(select *, {VALID} and coalesce({median('typ', 9)} <= 9, false) as _fz from (select *, list_median({_SP}) as typ from kin))", "_fz", 30, "freezing", KS)
WALK = sustain(f"(select *, coalesce({median('speed_body', 9)}, 0) >= 17 and coalesce(straight, 1) >= 0.3 as _wk from {STRAIGHT.replace('from kin', 'from fz')})", "_wk", 15, "walking", KS)
NEAR = "sqrt((o.center_x-nose_x)*(o.center_x-nose_x)+(o.center_y-nose_y)*(o.center_y-nose_y)) <= o.radius+12"
EXPL = sustain(f"(select p.*, o.object_id, {NEAR} as nr from {{src}} p join objects o on o.session_id=p.session_id)", "nr", 9, "exploring", "session_id, field, object_id")
LOW = sustain(f"(select *, {VALID} and coalesce({median('speed_body', 9)} < 17, false) and not freezing as _lo from {{src}})", "_lo", 15, "low_activity", KS)
HEAD = sustain(f"""(select *, coalesce({median('hs', 15)}, 0) >= 12 and coalesce({median('speed_body', 15)} < 12, false) and not object_interaction as _hd from (
    select *, 30*sqrt((hx-lag(hx) over w)*(hx-lag(hx) over w)+(hy-lag(hy) over w)*(hy-lag(hy) over w)) as hs from (
      select *, posx_neck-posx_body as hx, posy_neck-posy_body as hy from {{src}}) window w as (partition by {KS} order by frame)))""", "_hd", 15, "active_head", KS)
TRI = dict(
    pose=S.POSE_SQL, objects=S.OBJECTS_SQL, kin=S.kin_sql(), fz=FREEZE, wk=WALK,
    ob=f"select wk.*, coalesce(e.x, false) as object_interaction from wk left join (select session_id, frame, bool_or(exploring) as x from {EXPL.format(src='wk')} group by 1, 2) e on e.session_id=wk.session_id and e.frame=wk.frame",
    lo=LOW.format(src="ob"), hd=HEAD.format(src="lo"),
    tri=f"""select * exclude (low_activity), low_activity and not active_head as low_activity, not ({VALID}) as unscorable,
      (not (walking or freezing or (low_activity and not active_head) or object_interaction) or active_head) and {VALID} as review from hd""",
)
T = S.with_(**TRI)


def triaged(spark, sf) -> DataFrame:
    chain = lambda d, keys: D.triage(TS.frame_kinematics(d, keys=keys, distances=False), None, keys=keys)
    return scans.in_blocks(D.with_objects(S.pose(spark, sf), S.objects(spark, sf)), K2, D.REACH, chain)


@query(KIN + f"select session_id, frame, {VALID} as valid from kin")
def pose_valid(spark, sf):
    return kin(spark, sf).select("session_id", "frame", D.pose_valid().alias("valid"))


@query(S.with_(pose=S.POSE_SQL, kin=S.kin_sql(), fz="select * from kin") + f"select session_id, frame, walking from {WALK}")
def detect_walking(spark, sf):
    return D.detect_walking(kin(spark, sf)).select("session_id", "frame", "walking")


@query(KIN + f"select session_id, frame, freezing from {FREEZE}")
def detect_freezing(spark, sf):
    return D.detect_freezing(kin(spark, sf)).select("session_id", "frame", "freezing")


@query(S.with_(pose=S.POSE_SQL, objects=S.OBJECTS_SQL) + f"select session_id, object_id, frame, exploring from {EXPL.format(src='pose')}")
def object_exploration(spark, sf):
    return D.object_exploration(S.pose(spark, sf), S.objects(spark, sf)).select("session_id", "object_id", "frame", "exploring")


@query(S.with_(pose=S.POSE_SQL, kin=S.kin_sql(), fz=FREEZE) + f"select session_id, frame, low_activity from {LOW.format(src='fz')}")
def detect_low_activity(spark, sf):
    return D.detect_low_activity(D.detect_freezing(kin(spark, sf))).select("session_id", "frame", "low_activity")


@query(S.with_(**{k: TRI[k] for k in ("pose", "objects", "kin", "fz", "wk", "ob")}) + f"select session_id, frame, active_head from {HEAD.format(src='ob')}")
def detect_active_head(spark, sf):
    df = D.detect_object_interaction(kin(spark, sf), S.objects(spark, sf))
    return D.detect_active_head(df).select("session_id", "frame", "active_head")


RULES = ("walking", "freezing", "low_activity", "object_interaction", "active_head", "unscorable", "review")


@query(T + f"select session_id, frame, {', '.join(RULES)} from tri")
def triage(spark, sf):
    return triaged(spark, sf).select("session_id", "frame", *RULES)


MOVE = dict(
    TRI, mv=sustain(f"(select *, {VALID} and coalesce(speed, 0) >= 17 as _mv from (select *, {median('posx_body', 9)} as x, {median('posy_body', 9)} as y, {median('speed_body', 9)} as speed from ob))", "_mv", 9, "moving", KS),
    layer=f"""select session_id, field, frame, time_ms, x, y, speed, moving, {VALID} and not moving as still, freezing, not ({VALID}) as unscorable, object_interaction as exploring,
      sum(case when moving and smooth_step <= 30 then smooth_step else 0 end) over (partition by {KS} order by frame rows unbounded preceding) as distance from (
        select *, sqrt((x-lag(x) over w)*(x-lag(x) over w)+(y-lag(y) over w)*(y-lag(y) over w)) as smooth_step from mv window w as (partition by {KS} order by frame))""",
)
LAYER = S.with_(**MOVE)


def layer(spark, sf) -> DataFrame:
    chain = lambda d, keys: D.movement_rows(TS.frame_kinematics(d, keys=keys, distances=False), None, keys=keys)
    return D.layer_of(scans.in_blocks(D.with_objects(S.pose(spark, sf), S.objects(spark, sf)), K2, D.REACH, chain))


@query(LAYER + f"select session_id, frame, {rsql('x', 'y', 'speed')}, moving, still, freezing, unscorable, exploring, round(distance, 3) as distance from layer")
def movement_layer(spark, sf):
    return layer(spark, sf).select("session_id", "frame", *r6("x", "y", "speed"), "moving", "still", "freezing", "unscorable", "exploring", F.round("distance", 3).alias("distance"))


@query(LAYER + "select session_id, frame, round(distance, 3) as distance from layer")
def cumulative_distance(spark, sf):
    return layer(spark, sf).select("session_id", "frame", F.round("distance", 3).alias("distance"))


SUMMARY = """select session_id, round(count(*)/30e0, 1) as duration_s, round(100*avg(moving::int), 1) as moving_pct, round(100*avg(still::int), 1) as still_pct, round(100*avg(freezing::int), 1) as freezing_pct,
    round(100*avg(unscorable::int), 1) as unscorable_pct, round(max(distance), 0) as distance_px, round(coalesce(quantile_cont(case when moving then speed end, 0.5), 0), 1) as speed_moving_px_s,
    round(count(*) filter (exploring)/30e0, 1) as exploration_total_s, count(*) filter (exploring and not coalesce(l, false)) as exploration_bouts
    from (select *, lag(exploring) over (partition by session_id order by frame) as l from layer) group by 1"""


@query(LAYER + SUMMARY)
def session_summary(spark, sf):
    return D.session_summary(layer(spark, sf)).drop("field")


SEG = f"""(select session_id, min(lo) as start_frame, max(hi) as end_frame from (select *, sum(n) over (partition by session_id order by lo) as g from (
    select *, case when lo - lag(hi) over (partition by session_id order by lo) > 30 then 1 else 0 end as n from (
      select session_id, min(frame) as lo, max(frame) as hi from (select *, sum(n) over (partition by session_id order by frame) as g from (
        select *, case when frame-lag(frame) over (partition by session_id order by frame) > 2 then 1 else 0 end as n from tri where review)) group by session_id, g)))
    group by session_id, g)"""


#: tri is read three times: computed once.
@query(T.replace("tri as (", "tri as materialized (") + f"""select s.session_id, s.start_frame, s.end_frame, round(a.time_ms, 3) as start_ms, round(b.time_ms, 3) as end_ms, s.end_frame-s.start_frame+1 as n_frames from {SEG} s
    join tri a on a.session_id=s.session_id and a.frame=s.start_frame join tri b on b.session_id=s.session_id and b.frame=s.end_frame""")
def review_segments(spark, sf):
    # read three times
    out = D.review_segments(written(triaged(spark, sf).select("session_id", "field", "frame", "time_ms", "review"), "review"))
    return out.select("session_id", "start_frame", "end_frame", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), "n_frames")


def _found(threshold: float) -> str:
    masked = sustain("m", f"score >= {threshold}", 9, "s1")
    return bout_list(sustain(filled(masked, "s1", 15, "s2"), "s2", 9, "s3"), "s3")


@query(M[:-1] + f", mn as (select * from {_found(0.8)}), wk as (select * from {_found(0.3)} l where not exists (select 1 from mn where mn.session_id=l.session_id and mn.\"start\"<=l.\"end\" and l.\"start\"<=mn.\"end\")) "
    + """select e.session_id, e."start", e."end", round(max(m.score), 6) as peak, not weak and max(m.score)>=0.95 as accepted from (select *, false as weak from mn union all select *, true from wk) e
    join m on m.session_id=e.session_id and m.rn between e."start" and e."end" group by e.session_id, e."start", e."end", weak""")
def triage_episodes(spark, sf):
    df = S.masks(spark, sf).select("session_id", F.lit(0).alias("field"), "frame", "score")
    out = D.triage_episodes(df, "score", 0.3, 0.95, 0.8, keys=["session_id"])
    return out.select("session_id", "start", "end", *r6("peak"), "accepted")


# --- summaries of detectors ------------------------------------------------
@query(T + "select session_id, " + ", ".join(f"round(avg({c}::int), 6) as {c}" for c in ("walking", "freezing", "low_activity", "object_interaction", "review", "unscorable")) + ", round(1-avg(review::int), 6) as reduction from tri group by 1")
def composition(spark, sf):
    cols = ["walking", "freezing", "low_activity", "object_interaction", "review", "unscorable"]
    return metrics.composition(triaged(spark, sf), cols).select("session_id", *r6(*cols, "reduction"))


@query(T + "select session_id, round(1-avg(review::int), 6) as reduction from tri group by 1")
def reduction_rate(spark, sf):
    return metrics.reduction_rate(triaged(spark, sf)).select("session_id", *r6("reduction"))


@query(P + " union all ".join(f"select '{k}' as keypoint, round(avg(({k}_p>=0.25)::int), 6) as coverage, quantile_cont({k}_p, 0.5) as median_p, count(*) filter ({k}_p<0.25) as frames_lost from pose" for k in KEYPOINTS))
def keypoint_coverage(spark, sf):
    out = metrics.keypoint_coverage(S.pose(spark, sf), KEYPOINTS)
    return out.select("keypoint", *r6("coverage"), "median_p", "frames_lost")


@query(P + " union all ".join(f"select '{k}' as keypoint, " + ", ".join(f"round(quantile_cont({k}_p, {q / 100}), 3) as p{q}" for q in (5, 10, 25, 50, 75, 95)) + " from pose" for k in KEYPOINTS))
def confidence_percentiles(spark, sf):
    return metrics.confidence_percentiles(S.pose(spark, sf), KEYPOINTS)


@query(KIN + "select " + ", ".join(f"round(quantile_cont(speed_body, {q / 100}), 1) as p{q}" for q in (10, 25, 50, 75, 90, 95)) + " from kin")
def speed_percentiles(spark, sf):
    return metrics.speed_percentiles(kin(spark, sf))
