"""Queries of the interval and mask algebra and of two markings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import detectors, intervals, metrics, review, scans
from . import standins as S
from .registry import bout_list, filled, query, runs, sustain

MB = ["session_id", "behavior"]
KEY = ["session_id"]
M = S.with_(m=S.MASKS_SQL)
MARKS = S.with_(marks=S.MARKS_SQL)

MERGED = """(select session_id, behavior, min(start_frame) as start_frame, max(end_frame) as end_frame from (
    select *, sum(n) over (partition by session_id, behavior order by start_frame, end_frame rows unbounded preceding) as g from (
      select *, case when start_frame <= max(end_frame) over (partition by session_id, behavior order by start_frame, end_frame
        rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as n from marks))
    group by session_id, behavior, g)"""


@query(MARKS + f"select * from {MERGED}")
def merge_intervals(spark, sf):
    return intervals.merge_intervals(S.marks(spark, sf), MB)


@query(MARKS + """select * from (select *, max(end_frame) over (partition by session_id, behavior, annotator
    order by start_frame, end_frame rows between unbounded preceding and 1 preceding) as reach from marks) where start_frame <= reach""")
def overlap_audit(spark, sf):
    return intervals.overlap_audit(S.marks(spark, sf), [*MB, "annotator"])


def ticks(spark, sf) -> DataFrame:
    """Recorded frames: every row's start and the four minutes around it."""
    m = S.marks(spark, sf).select("session_id", F.explode(F.expr("sequence(start_frame - 2, start_frame + 2)")).alias("frame"))
    return m.distinct()


TICKS = "(select distinct session_id, start_frame + k as frame from marks cross join (select unnest(range(-2, 3)) as k))"


@query(MARKS + f"""select t.session_id, t.frame, exists (select 1 from marks x where x.behavior='click' and x.session_id=t.session_id
    and t.frame between x.start_frame and x.end_frame) as held from {TICKS} t""")
def intervals_to_frames(spark, sf):
    return intervals.intervals_to_mask(ticks(spark, sf), S.marks(spark, sf).filter("behavior = 'click'"), KEY, "held")


def event_types(spark, sf) -> list[str]:
    return ["click", "purchase", "search", "view"]


def labelled(spark, sf) -> DataFrame:
    return intervals.label_matrix(ticks(spark, sf), S.marks(spark, sf), KEY, event_types(spark, sf), "login")


def matrix_sql() -> str:
    held = lambda b: f"coalesce(bool_or(x.behavior='{b}'), false)"
    flags = ", ".join(f"{held(b)} as {b if b != 'view' else 'view_'}" for b in ("click", "purchase", "search", "view"))
    return f"""(select t.session_id, t.frame, {flags}, not {held('login')} as scorable from {TICKS} t left join marks x
        on x.session_id=t.session_id and t.frame between x.start_frame and x.end_frame group by 1, 2)"""


MATRIX = matrix_sql()


@query(MARKS + f"select * from {MATRIX}")
def label_matrix(spark, sf):
    return labelled(spark, sf).withColumnRenamed("view", "view_")


PROGRESS = """select session_id, case when session_id%2=0 then concat(cast(min(start_frame) as {varchar}), '-', cast(min(start_frame)+500 as {varchar}), ';',
      cast(min(start_frame)+2000 as {varchar}), '-', cast(min(start_frame)+9000 as {varchar})) end as seen,
    case when session_id%2=1 then min(start_frame)+3000 end as watched_until from {marks} group by session_id"""
PROGRESS_SQL = PROGRESS.replace("{varchar}", "varchar").replace("{marks}", "marks")


@query(MARKS + f"""select t.session_id, t.frame, case when t.session_id%2=0 then t.frame between p.s and p.s+500 or t.frame between p.s+2000 and p.s+9000
    else t.frame between 0 and p.s+3000 end as seen from {TICKS} t join (select session_id, min(start_frame) as s from marks group by 1) p using (session_id)""")
def seen_frames(spark, sf):
    m = S.marks(spark, sf)
    progress = spark.sql(PROGRESS.replace("{varchar}", "string"), marks=m)
    return intervals.intervals_to_mask(ticks(spark, sf), intervals.seen_intervals(progress), KEY, "seen")


@query(M + """select session_id, min(frame) as start_frame, max(frame) as end_frame from (select *, sum(n) over (partition by session_id order by frame
    rows unbounded preceding) as g from (select *, case when frame - lag(frame) over (partition by session_id order by frame) > 2 then 1 else 0 end as n
    from m where a)) group by session_id, g""")
def mask_to_bouts(spark, sf):
    return intervals.mask_to_bouts(S.masks(spark, sf), "a", KEY)


@query(M + f"select * from {bout_list('m', 'a')}")
def bouts(spark, sf):
    return intervals.bouts(S.masks(spark, sf), "a", KEY)


@query(M + "select session_id, cast(count(*) filter (a and not coalesce(l, false)) as bigint) as n_bouts from (select *, lag(a) over (partition by session_id order by frame) as l from m) group by 1")
def bout_count(spark, sf):
    return intervals.bout_count(S.masks(spark, sf), "a", KEY)


@query(M + f"select session_id, frame, s from {sustain('m', 'a', 6, 's')}")
def sustained(spark, sf):
    found = scans.in_blocks(S.masks(spark, sf), KEY, 6, lambda d, keys: intervals.sustained(d, "a", 6, keys, "s"))
    return found.select("session_id", "frame", "s")


@query(M + f"select session_id, frame, s from {filled('m', 'a', 3, 's')}")
def close_gaps(spark, sf):
    return intervals.close_gaps(S.masks(spark, sf), "a", 3, KEY, "s").select("session_id", "frame", "s")


@query(M + f"""select session_id, min("start") as "start", max("end") as "end" from (select *, sum(n) over (partition by session_id order by "start") as g
    from (select *, case when "start" - lag("end") over (partition by session_id order by "start") > 4 then 1 else 0 end as n from {bout_list('m', 'a')}))
    group by session_id, g""")
def merge_close_bouts(spark, sf):
    return intervals.merge_close_bouts(intervals.bouts(S.masks(spark, sf), "a", KEY), KEY, 4)


#: The pair rule by its definition: a counter along the runs, as a recursion.
JOINED = f"""
  bl as (select *, row_number() over (partition by session_id order by "start") as i from {bout_list('m', 'a')}),
  walk as (
    select session_id, i, "start", "end", 1 as joined, false as fill, cast(null as bigint) as prev from bl where i=1
    union all
    select b.session_id, b.i, b."start", b."end",
      case when (b."start"-w."end")/30e0 < 0.15e0 and w.joined < 2 then w.joined+1 else 1 end,
      (b."start"-w."end")/30e0 < 0.15e0 and w.joined < 2, w."end"
    from walk w join bl b on b.session_id=w.session_id and b.i=w.i+1)"""


@query("with recursive m as (" + S.MASKS_SQL + f"), {JOINED} " + """select m.session_id, m.frame, m.a or f.i is not null as s from m
    left join (select * from walk where fill) f on f.session_id=m.session_id and m.rn > f.prev and m.rn < f."start" """)
def join_episodes(spark, sf):
    return intervals.join_episodes(S.masks(spark, sf), "a", KEY, "s", gap_sec=0.15, max_join=2).select("session_id", "frame", "s")


@query(M + f"select session_id, frame, s from {sustain('m', 'b', 36, 's')}")
def drop_short(spark, sf):
    return detectors.drop_short(S.masks(spark, sf), "b", "s", keys=KEY).select("session_id", "frame", "s")


@query(M + f"select session_id, frame, _f and born as s from (select *, bool_or(score>=0.9) over (partition by session_id, _r) as born from {runs('m', 'score>=0.4')})")
def hysteresis(spark, sf):
    df = intervals.hysteresis(S.masks(spark, sf), F.col("score") >= 0.9, F.col("score") >= 0.4, KEY, "s")
    return df.select("session_id", "frame", "s")


@query(M + f"select session_id, frame, case when _f then round(least(row_number() over (partition by session_id, _r order by frame)/30e0, 0.2e0), 6) else 0e0 end as sec from {runs('m', 'a')}")
def run_seconds(spark, sf):
    df = scans.in_blocks(S.masks(spark, sf), KEY, 6, lambda d, keys: intervals.run_seconds(d, "a", keys, "sec", cap=0.2))
    return df.select("session_id", "frame", F.round("sec", 6).alias("sec"))


MERGED_GAP15 = MERGED.replace("preceding) + 1 then", "preceding) + 15 then")


@query(MARKS + f"""select t.session_id, t.frame, exists (select 1 from {MERGED_GAP15} x where x.behavior='click' and x.session_id=t.session_id
    and t.frame between x.start_frame and x.end_frame) as held from {TICKS} t""")
def label_mask(spark, sf):
    """Marks with the detection's definition of an episode: close ones joined."""
    own = intervals.merge_intervals(S.marks(spark, sf).filter("behavior = 'click'"), MB, 15)
    return intervals.intervals_to_mask(ticks(spark, sf), own, KEY, "held")


@query(M + f"select session_id, rn as centre, s as target from {filled('m', 'a', 15, 's')} where rn % 8 = 0")
def targets(spark, sf):
    """The label mask at the window centres."""
    df = intervals.close_gaps(S.masks(spark, sf), "a", 15, KEY, "target")
    return df.filter("rn % 8 = 0").select("session_id", F.col("rn").alias("centre"), "target")


GATED = sustain("(select *, j and not freezing as k from " + filled("m", "a", 0, "j") + ")", "k", 9, "s")


@query(M + f"select session_id, frame, s from {GATED}")
def gate(spark, sf):
    return detectors.gate(S.masks(spark, sf), "a", "grooming", "s", keys=KEY).select("session_id", "frame", "s")


@query(M + f"select session_id, frame, s from {sustain('m', 'score >= 0.7', 9, 's')}")
def frame_mask(spark, sf):
    return detectors.frame_mask(S.masks(spark, sf), "score", 0.7, "s", keys=KEY).select("session_id", "frame", "s")


@query(M + """select session_id, string_agg(concat(cast(lo as varchar), '-', cast(hi as varchar)), ';' order by lo) as ranges from (
    select session_id, min(frame) as lo, max(frame) as hi from (select *, sum(n) over (partition by session_id order by frame) as g from (
      select *, case when frame - lag(frame) over (partition by session_id order by frame) > 1 then 1 else 0 end as n from m where a)) group by session_id, g)
    group by session_id""")
def ranges_encode(spark, sf):
    return intervals.encode_ranges(S.masks(spark, sf), "a", KEY)


@query(M + """select session_id, frame as start_frame, frame as end_frame from m where false union all
    select session_id, min(frame), max(frame) from (select *, sum(n) over (partition by session_id order by frame) as g from (
      select *, case when frame - lag(frame) over (partition by session_id order by frame) > 1 then 1 else 0 end as n from m where a)) group by session_id, g""")
def ranges_decode(spark, sf):
    return intervals.decode_ranges(intervals.encode_ranges(S.masks(spark, sf), "a", KEY), "ranges", KEY)


OBJ = S.with_(pose=S.POSE_SQL, objects=S.OBJECTS_SQL)


@query(OBJ + f"""select b.session_id, b.field, b."start", b."end" from {bout_list("(select *, rn%40<25 as a from pose)", "a", "session_id, field")} b
    where exists (select 1 from pose p join objects o on o.session_id=p.session_id where p.session_id=b.session_id and p.rn between b."start" and b."end"
      and p.nose_x>=0 and p.nose_y>=0 and sqrt((p.nose_x-o.center_x)*(p.nose_x-o.center_x)+(p.nose_y-o.center_y)*(p.nose_y-o.center_y))-o.radius<15)""")
def object_bouts(spark, sf):
    df = S.pose(spark, sf).withColumn("a", F.expr("rn % 40 < 25"))
    return metrics.object_bouts(df, "a", S.objects(spark, sf))


IGN = f"""ig as (select * from {bout_list('m', 'a')} where "start" % 3 = 0),
  gone as (select * from {bout_list('m', 'b')} p where exists (select 1 from ig where ig.session_id=p.session_id and ig."start"<=p."end" and p."start"<=ig."end"))"""


@query("with m as (" + S.MASKS_SQL + f"), {IGN} " + """select session_id, frame,
    a and not exists (select 1 from ig where ig.session_id=m.session_id and rn between ig."start" and ig."end") as a,
    b and not exists (select 1 from gone g where g.session_id=m.session_id and rn between g."start" and g."end") as b from m""")
def ignore_bouts(spark, sf):
    df = S.masks(spark, sf)
    ignored = intervals.bouts(df, "a", KEY).filter("start % 3 = 0")
    return review.ignore_bouts(df, "a", "b", ignored).select("session_id", "frame", "a", "b")


LANES = f"""la as (select * from {bout_list('m', 'a and not unscorable')}), lb as (select * from {bout_list('m', 'b and not unscorable')}),
  ep as (select session_id, 'a' as lane, "start", "end", case when exists (select 1 from lb where lb.session_id=la.session_id and lb."start"<=la."end" and la."start"<=lb."end") then 'both' else 'only_a' end as status from la
    union all select session_id, 'b', "start", "end", case when exists (select 1 from la where lb.session_id=la.session_id and lb."start"<=la."end" and la."start"<=lb."end") then 'both' else 'only_b' end from lb),
  grp as (select session_id, min("start") as "start", max("end") as "end", case when min(lane)<>max(lane) then 'both' else 'only_'||min(lane) end as status from (
    select *, sum(n) over (partition by session_id order by "start", "end", lane rows unbounded preceding) as g from (select *, case when "start" > max("end") over (partition by session_id order by "start", "end", lane
      rows between unbounded preceding and 1 preceding) then 1 else 0 end as n from ep)) group by session_id, g),
  mk as (select session_id, 'a' as lane, "start" as start_frame, "end" as end_frame from la union all select session_id, 'b', "start", "end" from lb)"""
L = "with m as (" + S.MASKS_SQL + f"), {LANES} "


def episodes(spark, sf):
    return review.compare_episodes(S.masks(spark, sf))


def lane_marks(ep):
    return ep.select("session_id", "lane", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))


@query(L + "select * from ep")
def compare_episodes(spark, sf):
    return episodes(spark, sf)


@query(L + "select * from ep where status <> 'both'")
def disagreements(spark, sf):
    return review.disagreements(episodes(spark, sf))


@query(M + "select session_id, frame, case when unscorable then 'unscorable' when a and b then 'both' when a then 'only_a' when b then 'only_b' end as status from m")
def frame_status(spark, sf):
    return review.frame_status(S.masks(spark, sf)).select("session_id", "frame", "status")


@query(L + """select g.session_id, g."start", g."end", g.status, count(k.start_frame) filter (k.lane='a') as marks_a, count(k.start_frame) filter (k.lane='b') as marks_b
    from grp g left join mk k on k.session_id=g.session_id and k.start_frame<=g."end" and k.end_frame>=g."start" group by all""")
def decision_groups(spark, sf):
    ep = episodes(spark, sf)
    groups = review.decision_groups(ep)
    listed = review.group_marks(groups, lane_marks(ep)).groupBy("session_id", "start", "end").pivot("lane", ["a", "b"]).agg(F.first(F.size("marks")))
    out = groups.join(listed, ["session_id", "start", "end"], "left").na.fill(0, ["a", "b"])
    return out.select("session_id", "start", "end", "status", F.col("a").cast("long").alias("marks_a"), F.col("b").cast("long").alias("marks_b"))


@query(L + """select g.session_id, concat(cast(g."start" as varchar), '-', cast(g."end" as varchar)) as group_key, k.start_frame, k.end_frame from grp g join mk k
    on k.session_id=g.session_id and k.lane='b' and k.start_frame<=g."end" and k.end_frame>=g."start" where g.status='both'""")
def initial_consensus(spark, sf):
    ep = episodes(spark, sf)
    return review.initial_consensus(review.decision_groups(ep), lane_marks(ep), "b")


DECIDED = """dec as (select *, case "start" % 4 when 0 then 'a' when 1 then 'b' else 'none' end as choice from grp where "start" % 4 < 3)"""


@query(L[:-1] + f", {DECIDED} " + """select session_id, start_frame, end_frame from mk where lane='a' and not exists (select 1 from dec d where d.session_id=mk.session_id and mk.start_frame<=d."end" and mk.end_frame>=d."start")
    union all select distinct k.session_id, k.start_frame, k.end_frame from dec d join mk k on k.session_id=d.session_id and k.lane=d.choice and k.start_frame<=d."end" and k.end_frame>=d."start" """)
def apply_decisions(spark, sf):
    ep = episodes(spark, sf)
    groups, marks = review.decision_groups(ep), lane_marks(ep)
    choice = F.when(F.col("start") % 4 == 0, "a").when(F.col("start") % 4 == 1, "b").otherwise("none")
    decisions = groups.filter("start % 4 < 3").select("session_id", review.span_key().alias("group_key"), choice.alias("choice"))
    return review.apply_decisions(groups, marks, decisions, marks.filter("lane = 'a'").drop("lane"))


@query(L + """select session_id, count(*) as "groups", count(*) filter ("start" % 4 >= 3) as pending from grp group by 1""")
def pending_groups(spark, sf):
    groups = review.decision_groups(episodes(spark, sf))
    decisions = groups.filter("start % 4 < 3").select("session_id", review.span_key().alias("group_key"))
    return review.pending(groups, decisions)


@query(MARKS + """select session_id, behavior, a_start, b_start, round(greatest(0, least(a_end, b_end) - greatest(a_start, b_start) + 1)::double
    / (a_end - a_start + 1 + b_end - b_start + 1 - greatest(0, least(a_end, b_end) - greatest(a_start, b_start) + 1)), 6) as iou from (
    select session_id, behavior, start_frame as a_start, end_frame as a_end, lead(start_frame) over w as b_start, lead(end_frame) over w as b_end
    from marks window w as (partition by session_id, behavior order by start_frame, end_frame)) where b_start is not null""")
def interval_iou(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy(*MB).orderBy("start_frame", "end_frame")
    df = S.marks(spark, sf).withColumn("b_start", F.lead("start_frame").over(w)).withColumn("b_end", F.lead("end_frame").over(w)).filter("b_start is not null")
    iou = scalars.interval_iou(F.col("start_frame"), F.col("end_frame"), F.col("b_start"), F.col("b_end"))
    return df.select(*MB, F.col("start_frame").alias("a_start"), "b_start", F.round(iou, 6).alias("iou"))
