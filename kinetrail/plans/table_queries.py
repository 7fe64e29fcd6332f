"""Queries of sources, sinks and session facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import intervals
from ..sources import tables as TB
from ..sources.scratch import fresh_path as _shared
from . import standins as S
from .registry import query
from .series_queries import FLOOR, LAYER, SUMMARY, layer, r6


FEATURE_SQL = """select cast(rn as bigint) as frame, session_id, cast(l_quantity as double) as move_nose, cast(l_discount as double) as move_body, cast(rn % 6 as int) as rule_label from ({frames})"""


@query(FEATURE_SQL.replace("{frames}", S.FRAMES.replace("{lineitem}", "lineitem")))
def read_features(spark, sf):
    """Rule features written as CSV and read through the checked reader."""
    f = spark.sql(FEATURE_SQL.replace("{frames}", S.FRAMES), lineitem=S.read(spark, sf, "lineitem"))
    path = _shared(spark, "features")
    others = [c.name for c in TB.FEATURES if c.name not in f.columns]
    f.select("session_id", *(F.lit("").alias(c) for c in others), "frame", "move_nose", "move_body", "rule_label").write.csv(path, header=True)
    raw = TB.read_csv(spark, path, TB.T.StructType([TB.T.StructField("session_id", TB.T.LongType()), *TB.FEATURES.fields]))
    return TB.unique_frames(raw, ["session_id", "frame"]).select("frame", "session_id", "move_nose", "move_body", "rule_label")





@query(S.with_(marks=S.MARKS_SQL) + "select session_id, behavior, start_frame, end_frame from marks where behavior not in ('click', 'view') or behavior is null or start_frame > end_frame")
def read_labels(spark, sf):
    """The violations that the reader refuses: unknown behaviours, wrong ends."""
    return TB.label_violations(S.marks(spark, sf), ["click", "view"]).select("session_id", "behavior", "start_frame", "end_frame")


@query(S.with_(marks=S.MARKS_SQL) + "select session_id, behavior, start_frame, end_frame from marks")
def load_labels(spark, sf):
    """Bouts written as CSV by session and read through the check in the plan."""
    m, path = S.marks(spark, sf), _shared(spark, "labels")
    m.select("session_id", F.lit("").alias("animal_id"), F.lit(0).alias("field"), "behavior", "start_frame", "end_frame", "annotator").write.csv(path, header=True)
    kinds = sorted(r[0] for r in m.select("behavior").distinct().collect())  # a vocabulary: few words
    return TB.read_labels(spark, path, kinds).select(F.col("session_id").cast("long").alias("session_id"), "behavior", "start_frame", "end_frame")


@query("with f as (" + S.FRAMES.replace("{lineitem}", "lineitem") + ") select concat('S', cast(session_id as varchar)) as session_id, rn as frame, cast(l_quantity as double) as motion_head from f")
def read_sessions(spark, sf):
    """A folder of CSV per session, the id in the folder's name."""
    f = spark.sql(S.FRAMES, lineitem=S.read(spark, sf, "lineitem"))
    path = _shared(spark, "sessions")
    one = f.select(F.concat(F.lit("S"), F.col("session_id").cast("string")).alias("session_id"), F.col("rn").alias("frame"), F.col("l_quantity").alias("motion_head"))
    TB.write_sessions(one, path)
    schema = TB.struct("frame long, motion_head double")
    return TB.read_sessions(spark, path, schema)


CORNERS = "select 'A' || cast(session_id as varchar) as arena, k as corner, case k when 1 then ax when 2 then bx when 3 then cx else dx end as x, case k when 1 then ay when 2 then by_ when 3 then cy else dy end as y from fl cross join (select unnest([3, 1, 4, 2]) as k)"


def corners(spark, sf) -> DataFrame:
    f = spark.sql(FLOOR, supplier=S.read(spark, sf, "supplier")).withColumn("corner", F.explode(F.array(*map(F.lit, (3, 1, 4, 2)))))
    pick = lambda *c: F.element_at(F.array(*c), F.col("corner"))
    return f.select(F.concat(F.lit("A"), "session_id").alias("arena"), "corner", pick("ax", "bx", "cx", "dx").alias("x"), pick("ay", "by_", "cy", "dy").alias("y"))


FLS = S.with_(fl=FLOOR.replace("{supplier}", "supplier"), cn=CORNERS)


@query(FLS + "select arena, string_agg(cast(cast(round(x*10) as bigint) as varchar) || ':' || cast(cast(round(y*10) as bigint) as varchar), ' ' order by corner) as corners from cn group by 1")
def load_floors(spark, sf):
    out = TB.load_floors(corners(spark, sf))
    text = F.transform("polygon", lambda c: F.concat_ws(":", F.round(c.x * 10).cast("long").cast("string"), F.round(c.y * 10).cast("long").cast("string")))
    return out.select("arena", F.array_join(text, " ").alias("corners"))


@query(FLS + """select arena, round(x, 6) as x, round(y, 6) as y, cast((i - first_value(i) over (partition by arena order by x+y, i) + 4) % 4 as bigint) as corner from (
    select *, row_number() over (partition by arena order by atan2(y-cy_, x-cx_)) - 1 as i from (select *, avg(x) over (partition by arena) as cx_, avg(y) over (partition by arena) as cy_ from cn))""")
def order_corners(spark, sf):
    out = TB.order_corners(corners(spark, sf).drop("corner"))
    return out.select("arena", *r6("x", "y"), F.col("corner").cast("long").alias("corner"))


FOR_SQL = """select s.session_id, case when s.session_id%3=0 then concat(cast(cast(round(ax*10) as bigint) as varchar), ':', cast(cast(round(ay*10) as bigint) as varchar))
    else concat(cast(cast(round(x1*10) as bigint) as varchar), ':', cast(cast(round(y1*10) as bigint) as varchar)) end as first_corner from fl s join
    (select session_id, quantile_cont(body_x, 0.01) as x1, quantile_cont(body_y, 0.01) as y1 from pose where body_p>=0.25 group by 1) using (session_id)"""


@query(S.with_(pose=S.POSE_SQL, fl=FLOOR.replace("{supplier}", "supplier")) + FOR_SQL)
def floor_for(spark, sf):
    """Marked floors for every third session, else the percentile rectangle."""
    floors = TB.load_floors(corners(spark, sf))
    marked = floors.filter(F.substring("arena", 2, 20).cast("long") % 3 == 0)
    sessions = S.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("session_id"), F.concat(F.lit("A"), "s_suppkey").alias("arena"))
    out = TB.floor_for(sessions, marked, S.pose(spark, sf)).filter("polygon is not null")
    one = F.col("polygon")[0]
    return out.select("session_id", F.concat_ws(":", F.round(one["x"] * 10).cast("long").cast("string"), F.round(one["y"] * 10).cast("long").cast("string")).alias("first_corner"))


LINES = """select o_orderkey as line, case when o_orderkey%25=1 then concat('Dia ', cast(o_orderkey%7+1 as {v})) else '' end as c0, case when o_orderkey%25=1 then '' else cast(o_custkey as {v}) end as c1, concat(cast(o_orderkey%3+1 as {v}), 'a') as c2,
    concat('1.', cast(100+o_orderkey%900 as {v}), ',5') as c3, cast(o_orderkey%50 as {v}) as c5, '' as c11, concat(cast(o_orderkey%20 as {v}), ',25') as c12 from {t}"""


@query(S.with_(ln=LINES.replace("{v}", "varchar").replace("{t}", "orders")) + """select concat('HD', cast(day as varchar), '_F', c1, '_cam', cast(o as varchar)) as session_id, day, concat('F', c1) as rat, c2 as box, cast(c5 as double) as rearings_20min, cast(replace(c12, ',', '.') as double) as rearings_5min,
    cast(replace(replace(c3, '.', ''), ',', '.') as double) as distance_20min_m, cast(null as double) as distance_5min_m from (select *, cast(last_value(case when c0 like 'Dia%' then cast(string_split(c0, ' ')[2] as int) end ignore nulls) over (order by line) as bigint) as day, line%3+1 as o from ln) where day is not null and c1<>''""")
def import_counts(spark, sf):
    lines = spark.sql(LINES.replace("{v}", "string").replace("{t}", "{orders}"), orders=S.read(spark, sf, "orders"))
    out = TB.import_counts(lines)
    return out.withColumn("day", F.col("day").cast("long"))


VIDEOS = "select concat(case when p_partkey%3=0 then concat('Dia ', cast(p_partkey as {v}), ' - ') else concat('tr ', '') end, cast(p_partkey as {v}), '-X-', cast(p_partkey+1 as {v}), '.mp4') as name, md5(cast(p_partkey%150 as {v})) as digest from {t}"


@query(S.with_(vd=VIDEOS.replace("{v}", "varchar").replace("{t}", "part")) + """select concat(phase, '_', a, '_cam', cast(i as varchar)) as session_id, a as animal_id, phase, cast(i as bigint) as camera, cast(i-1 as bigint) as field, name as source_video from (
    select *, unnest([1, 2, 3]) as i, unnest(string_split(regexp_extract(name, '([0-9]+-X-[0-9]+)', 1), '-')) as a, case when name like 'Dia%' then 'HD'||regexp_extract(name, 'Dia ([0-9]+)', 1) else 'TR' end as phase
    from (select *, row_number() over (partition by digest order by name) as r from vd) where r=1) where a<>'X'""")
def build_manifest(spark, sf):
    files = spark.sql(VIDEOS.replace("{v}", "string").replace("{t}", "{part}"), part=S.read(spark, sf, "part"))
    out = TB.build_manifest(files)
    return out.withColumn("camera", F.col("camera").cast("long")).withColumn("field", F.col("field").cast("long"))


@query(S.with_(marks=S.MARKS_SQL) + "select session_id, annotator, behavior, start_frame, end_frame from marks where session_id % 5 <> 0 or annotator <> 1 union all select session_id, annotator, behavior, start_frame+1, end_frame+1 from marks where session_id % 5 = 0 and annotator = 1")
def replace_rows(spark, sf):
    m = S.marks(spark, sf).select("session_id", "annotator", "behavior", "start_frame", "end_frame")
    fresh = m.filter("session_id % 5 = 0 and annotator = 1").selectExpr("session_id", "annotator", "behavior", "start_frame + 1 as start_frame", "end_frame + 1 as end_frame")
    return TB.replace_rows(m, fresh)


@query("select user_id as session_id, event_type as object_id, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) where r=1")
def keep_last(spark, sf):
    e = S.read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("object_id"), "event_id", "value")
    return TB.keep_last(e, ["session_id", "object_id"], "event_id")


@query(S.with_(clips=S.CLIPS_SQL) + "select row_number() over (order by md5(clip_id || '|7')) as position, clip_id, session_id, start_frame, end_frame from clips")
def write_round(spark, sf):
    from ..operators.sampling import write_round as round_

    blind, _ = round_(S.clips(spark, sf), 7)
    return blind.withColumn("position", F.col("position").cast("long"))


@query(LAYER + f"select s.*, frames, way from ({SUMMARY}) s join (select session_id, count(*) as frames, round(max(distance), 3) as way from layer group by 1) using (session_id)")
def write_layers(spark, sf):
    """The movement layer written by session with its summary; both read back."""
    from ..operators.detectors import session_summary

    path, own = _shared(spark, "layers"), layer(spark, sf)
    TB.write_layers(own, session_summary(own), path)
    frames = spark.read.parquet(f"{path}/layers").groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.max("distance"), 3).alias("way"))
    return spark.read.parquet(f"{path}/summary").drop("field").join(frames, "session_id")


DIGESTS = "select o_custkey as session_id, {d}(concat(cast(count(*) as {v}), '|', cast(max(o_orderkey) as {v}))) as digest from {t} group by 1"


@query(S.with_(a=DIGESTS.replace("{v}", "varchar").replace("{d}", "md5").replace("{t}", "orders")) + """select session_id, cache_key from (select session_id, sha256(concat('0:', digest, '|1:', digest)) as cache_key from a) where session_id%4<>0
    union all select session_id, sha256(concat('0:', digest, '|1:', digest)) from a where session_id%4=0 and session_id%8=0""")
def stale_sessions(spark, sf):
    d = spark.sql(DIGESTS.replace("{v}", "string").replace("{d}", "md5").replace("{t}", "{orders}"), orders=S.read(spark, sf, "orders"))
    now = TB.input_digest([d, d])
    stored = now.filter("session_id % 4 = 0").withColumn("cache_key", F.when(F.col("session_id") % 8 == 0, F.lit("old")).otherwise(F.col("cache_key")))
    return TB.stale_sessions(now, stored)


@query("""select folder, count(*) as images, count(*) filter (n=3) as complete, count(*) filter (n in (1, 2)) as partial, count(*) filter (n=0) as "empty" from (
    select p_brand as folder, case when p_partkey%11=0 then 0 else floor(((p_size%2<>0)::int*2 + (p_size%3<>0)::int*2 + (p_size%5<>0)::int*2)/2) end as n from part) group by 1""")
def label_completeness(spark, sf):
    p = S.read(spark, sf, "part")
    images = p.select(F.col("p_brand").alias("folder"), F.col("p_partkey").alias("image"))
    xy = {f"{a}{i}": F.when(F.col("p_size") % i != 0, F.lit(1.0)) for i in (2, 3, 5) for a in "xy"}
    points = p.filter("p_partkey % 11 <> 0").select(F.col("p_brand").alias("folder"), F.col("p_partkey").alias("image"), *(c.alias(n) for n, c in xy.items()))
    return TB.label_completeness(images, points, list(xy), 3)


@query("""select session_id, arena, animal from (select s, concat(case when s like 'HD%' then 'HD' else 'NOR' end, '_cam', string_split(s, '_cam')[-1]) as arena, s as session_id,
    case when regexp_full_match(string_split(s, '_')[2], '[0-9]+') then cast(cast(string_split(s, '_')[2] as bigint) as varchar) else string_split(s, '_')[2] end as animal from (
      select case when s_suppkey%2=0 then concat('TR_0', cast(s_suppkey as varchar), '_cam', cast(s_suppkey%3+1 as varchar)) else concat('HD1_F', cast(s_suppkey as varchar), '_cam2') end as s from supplier))""")
def parse_session_id(spark, sf):
    k = F.col("s_suppkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("TR_0"), k.cast("string"), F.lit("_cam"), (k % 3 + 1).cast("string"))).otherwise(F.concat(F.lit("HD1_F"), k.cast("string"), F.lit("_cam2")))
    return S.read(spark, sf, "supplier").select(name.alias("session_id")).select("session_id", scalars.arena_of("session_id").alias("arena"), scalars.animal_of("session_id").alias("animal"))


@query("select p_partkey, round(cast(p_size as double)/100, 6) as low, round((p_size+10)::double/100, 6) as high from part")
def band_edges(spark, sf):
    name = F.concat(F.lit("band_"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("_"), (F.col("p_size") + 10).cast("string"))
    low, high = scalars.band_edges("band")
    return S.read(spark, sf, "part").withColumn("band", name).select("p_partkey", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


PROG = "select o_custkey as session_id, case when o_custkey%3=0 then null when o_custkey%3=1 then 'rearing;grooming' else 'sniffing' end as behaviors, case when o_custkey%4=0 then null else o_custkey%4=1 end as assisted from {t} group by o_custkey"


@query(S.with_(p=PROG.replace("{t}", "orders")) + "select session_id from p where (behaviors is null or list_contains(string_split(behaviors, ';'), 'rearing')) and not coalesce(assisted, false) and session_id%10<>0")
def blind_sessions(spark, sf):
    p = spark.sql(PROG.replace("{t}", "{orders}"), orders=S.read(spark, sf, "orders"))
    return TB.blind_sessions(p, "rearing", p.filter("session_id % 10 = 0")).select("session_id")


@query()
def stream_sessions(spark, sf):
    """Marks as arriving files, merged per micro-batch and appended by session."""
    from ..streaming.ingest import ingest_sessions

    home, out = _shared(spark, "arriving"), _shared(spark, "merged")
    S.marks(spark, sf).repartition(4, "session_id").write.parquet(home)
    stream = spark.readStream.schema(S.marks(spark, sf).schema).option("maxFilesPerTrigger", 1).parquet(home)
    ingest_sessions(stream, lambda b: intervals.merge_intervals(b, ["session_id", "behavior"]), out, _shared(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out)


