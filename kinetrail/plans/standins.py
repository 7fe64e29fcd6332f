"""Views over the benchmark tables in the roles of the domain's tables.

Each view is one text that Spark and the SQL engine both run; numbers are whole
or made by the same double operations in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FRAMES = """
  select l_suppkey as session_id, l_discount, l_tax, l_quantity,
         cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice,
              l_quantity, l_discount, l_tax, l_shipdate) - 1 as bigint) as rn
  from {lineitem}"""

#: A walk with slow and still phases, a working head, missing poses.
POSE = f"""
  select session_id, cast(0 as bigint) as field, rn as frame, rn, cast(rn as double)*1000e0/30e0 as time_ms,
    cast(body_x as double) as body_x, cast(body_y as double) as body_y, cast(p as double) as body_p,
    cast(body_x+wob as double) as neck_x, cast(body_y-8 as double) as neck_y, cast(p as double) as neck_p,
    cast(body_x+wob as double) as nose_x, cast(body_y-20 as double) as nose_y,
    cast(case when l_tax>0.075e0 then 0.1e0 else p end as double) as nose_p,
    cast(body_x+wob-4 as double) as ear_left_x, cast(body_y-10 as double) as ear_left_y, cast(p as double) as ear_left_p,
    cast(body_x+wob+4 as double) as ear_right_x, cast(body_y-10 as double) as ear_right_y, cast(p as double) as ear_right_p,
    cast(body_x as double) as tail_base_x, cast(body_y+15 as double) as tail_base_y, cast(p as double) as tail_base_p
  from (select *, (600+abs(u10 % 2400 - 1200))/10e0 as body_x, 40+session_id%100+l_discount as body_y,
               case when ph>=120 and cyc%2=1 then rn%2 else 0 end as wob,
               case when rn%97<3 then 0.1e0 else 0.8e0 end as p
        from (select *, rn % 180 as ph, cast(floor(rn/180e0) as bigint) as cyc,
                     cast(floor(rn/180e0) as bigint)*1440 + case when rn%180<60 then 20*(rn%180)
                       when rn%180<120 then 1200+4*(rn%180-60) else 1440 end as u10
              from ({FRAMES})))"""

#: Two masks with runs, holes in the frame numbers, scores and flags.
MASKS = f"""
  select session_id, rn, rn + 3*cast(floor(rn/50e0) as bigint) as frame,
    ((cast(floor(rn/4e0) as bigint)+session_id)%3<>0 and rn%17<>5) as a,
    ((cast(floor(rn/6e0) as bigint)+2*session_id)%4<2) as b,
    (cast(floor(rn/70e0) as bigint)+session_id)%3=1 as freezing,
    rn%37<2 as unscorable, rn%23=0 as missing,
    abs(((rn*3+13*session_id)%101)-50)/50e0 as score
  from ({FRAMES})"""

CLIPS = f"""
  select concat(cast(session_id as {{varchar}}), '_', cast(start_frame as {{varchar}})) as clip_id, session_id, start_frame,
    start_frame+29 as end_frame,
    case k%3 when 0 then 'walking' when 1 then 'freezing' else 'review' end as triage_label,
    case (session_id+k)%3 when 0 then 'r1' when 1 then 'r2' else 'test' end as round,
    case (session_id+2*k)%6 when 0 then 'grooming' when 1 then 'other' when 2 then 'unscorable' when 3 then 'rearing'
      when 4 then 'walking' else 'object_interaction' end as label,
    case when k%4=1 then 'sniffing' when k%4=2 then 'sniffing;rearing' else '' end as also,
    case when k%5=3 then 'rearing;grooming' else '' end as labels,
    case k%3 when 0 then 0.5e0 when 1 then 0.3e0 else 0.2e0 end as band_share
  from (select session_id, rn as start_frame, cast(floor(rn/40e0) as bigint) as k from ({FRAMES}) where rn%40=0)"""

OBJECTS = """
  select s_suppkey as session_id, cast(1 as bigint) as object_id, cast(80 as double) as center_x,
         cast(20+s_suppkey%100 as double) as center_y, cast(10 as double) as radius from {supplier}
  union all
  select s_suppkey, cast(2 as bigint), cast(150 as double), cast(30+s_suppkey%100 as double), cast(8 as double)
  from {supplier} where s_suppkey%2=0"""

MARKS_SPARK = """
  select user_id as session_id, event_type as behavior,
    cast(floor((unix_micros(cast(ts as timestamp))/1000000-1704067200)/60) as bigint) as start_frame,
    cast(floor((unix_micros(cast(ts as timestamp))/1000000-1704067200)/60)+ceil(value*10) as bigint) as end_frame,
    cast(get_json_object(props,'$.k') as bigint) % 2 as annotator
  from {events}"""
MARKS_SQL = """
  select user_id as session_id, event_type as behavior,
    cast(floor((epoch_us(ts)/1000000-1704067200)/60) as bigint) as start_frame,
    cast(floor((epoch_us(ts)/1000000-1704067200)/60)+ceil(value*10) as bigint) as end_frame,
    cast(json_extract_string(props,'$.k') as bigint) % 2 as annotator
  from events"""
KEYPOINTS = ("nose", "ear_left", "ear_right", "neck", "body", "tail_base")


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = [n for n in ("lineitem", "supplier", "events") if "{" + n + "}" in text]
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return spark.sql(text.replace("{varchar}", "string"), **tables)


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, POSE)


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MASKS)


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CLIPS)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, OBJECTS)


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MARKS_SPARK)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(text: str) -> str:
    for name in ("lineitem", "supplier", "events"):
        text = text.replace("{" + name + "}", name)
    return text.replace("{varchar}", "varchar")


POSE_SQL, MASKS_SQL, CLIPS_SQL, OBJECTS_SQL = map(_sql, (POSE, MASKS, CLIPS, OBJECTS))


def kin_sql(src: str = "pose", fps: int = 30) -> str:
    """SQL: masked positions and speeds of every keypoint."""
    cols = ", ".join(f"case when {k}_p>=0.25 then {k}_{a} end as pos{a}_{k}" for k in KEYPOINTS for a in "xy")
    dx = lambda k, a: f"(pos{a}_{k}-lag(pos{a}_{k}) over w)"
    speeds = ", ".join(f"sqrt({dx(k, 'x')}*{dx(k, 'x')}+{dx(k, 'y')}*{dx(k, 'y')})*{fps}e0 as speed_{k}" for k in KEYPOINTS)
    return f"(select *, {speeds} from (select *, {cols} from {src}) window w as (partition by session_id, field order by frame))"


def with_(**parts: str) -> str:
    """A WITH clause of the named parts."""
    return "with " + ", ".join(f"{n} as ({t})" for n, t in parts.items()) + " "
