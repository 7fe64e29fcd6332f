"""Interval and mask algebra.

Intervals are rows (keys..., start_frame, end_frame), both ends inclusive. Masks
are boolean columns of a frame table with one row per (keys..., order). Bouts
count rows (positions from 0) or frame numbers, as each function says.

All windows are partitioned by the keys and ordered by the frame, so that a
chain of these operators is shuffled once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import MAX_FRAME_GAP, PAIR_RULE
from . import dyadic, scans

KEYS = ("session_id",)


with_position = scans.with_position


def merge_intervals(df: DataFrame, keys: Sequence[str], gap: int = 0) -> DataFrame:
    """Intervals of a key that overlap, touch or lie up to gap apart become one."""
    order = Window.partitionBy(*keys).orderBy("start_frame", "end_frame")
    reach = F.max("end_frame").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | (F.col("start_frame") > reach + max(1, gap))
    grouped = df.withColumn("_new", opens.cast("int")).withColumn(
        "_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        grouped.groupBy(*keys, "_island")
        .agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))
        .drop("_island")
    )


def overlap_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that begin before an earlier row of the same key has ended."""
    order = Window.partitionBy(*keys).orderBy("start_frame", "end_frame")
    reach = F.max("end_frame").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("reach", reach).filter(F.col("start_frame") <= F.col("reach"))


def range_join(frames: DataFrame, intervals: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """Frames with the intervals (start_frame, end_frame) of their key that hold
    them. An interval of any length is a few rows of the join, which has keys
    beyond the session."""
    return dyadic.point_join(frames, intervals, keys, frame, "start_frame", "end_frame")


def intervals_to_mask(frames: DataFrame, intervals: DataFrame, keys: Sequence[str], name: str, frame: str = "frame") -> DataFrame:
    """frames with a boolean column: does an interval of the key hold the frame?"""
    held = range_join(frames.select(*keys, frame), intervals.select(*keys, "start_frame", "end_frame"), keys, frame)
    held = held.select(*keys, frame).distinct().select([F.col(k).alias(f"_{k}") for k in keys] + [F.col(frame).alias("_frame"), F.lit(True).alias("_held")])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(frame) == F.col("_frame")]
    out = frames.join(held, on, "left").withColumn(name, F.coalesce("_held", F.lit(False)))
    return out.drop("_frame", "_held", *(f"_{k}" for k in keys))


def label_matrix(
    frames: DataFrame, labels: DataFrame, keys: Sequence[str], behaviors: Sequence[str], unscorable: str | None = "unscorable"
) -> DataFrame:
    """A boolean column per behaviour and, with unscorable, the column scorable."""
    hits = range_join(frames.select(*keys, "frame"), labels.select(*keys, "behavior", "start_frame", "end_frame"), keys)
    flags = [F.bool_or(F.col("behavior") == b).alias(b) for b in behaviors]
    if unscorable:
        flags.append(F.bool_or(F.col("behavior") == unscorable).alias("_blind"))
    wide = hits.groupBy(*keys, "frame").agg(*flags)
    out = frames.join(wide, [*keys, "frame"], "left")
    for b in behaviors:
        out = out.withColumn(b, F.coalesce(b, F.lit(False)))
    return out.withColumn("scorable", ~F.coalesce("_blind", F.lit(False))).drop("_blind") if unscorable else out


def with_runs(df: DataFrame, flag: str | Column, keys: Sequence[str], order: str = "frame", prefix: str = "_") -> DataFrame:
    """Adds {prefix}flag (null is false), {prefix}run and {prefix}len: runs of
    equal flags in row order and their length in rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    f, run = f"{prefix}flag", f"{prefix}run"
    out = df.withColumn(f, F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False)))
    changed = F.coalesce((F.col(f) != F.lag(f).over(w)).cast("int"), F.lit(0))
    out = out.withColumn(run, changed).withColumn(run, F.sum(run).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn(f"{prefix}len", F.count(F.lit(1)).over(Window.partitionBy(*keys, run)))


def _without(df: DataFrame, prefix: str = "_") -> DataFrame:
    return df.drop(f"{prefix}flag", f"{prefix}run", f"{prefix}len")


#: Rows of a shortest run up to which sustained() looks ahead row by row.
LOOK_AHEAD = 128


def _since_broken(df: DataFrame, flag: str | Column, keys: Sequence[str], order: str) -> DataFrame:
    """Adds _flag (null is false) and _far, the rows since the last false one: how
    long a true run has lasted, in the order of the rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    value = F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))
    held = df.withColumns({"_flag": value, "_nth": F.row_number().over(w)})
    broken = F.max(F.when(~F.col("_flag"), F.col("_nth"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("_far", F.col("_nth") - F.coalesce(broken, F.lit(0))).drop("_nth")


def sustained(df: DataFrame, flag: str | Column, rows: int, keys: Sequence[str], out: str, order: str = "frame") -> DataFrame:
    """The flag without runs of fewer than rows rows."""
    return sustained_each(df, {out: (flag, rows)}, keys, order)


def sustained_each(
    df: DataFrame, flags: Mapping[str, tuple[str | Column, int]], keys: Sequence[str], order: str = "frame", nth: str | None = None
) -> DataFrame:
    """Flags by their new name, without runs of fewer rows than each asks for; all
    flags share the windows. nth: a column with the row's number from 1, if there is one.

    A row stays if its run, counted from its beginning, reaches rows here or in
    the next rows - 1 rows: a run that began later cannot. So the rows keep their
    order, and a chain of detectors is sorted once. Runs that have reached rows are
    counted as they go, and the count rows - 1 rows on tells, whatever rows is,
    where a maximum over the rows ahead would be taken anew for every row; a very long
    shortest run is measured by run instead.
    """
    value = {out: F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False)) for out, (flag, _) in flags.items()}
    looked = {out: rows for out, (_, rows) in flags.items() if 1 < rows <= LOOK_AHEAD}
    held = df.withColumns({f"_flag_{out}": v for out, v in value.items()})
    if looked:
        w = Window.partitionBy(*keys).orderBy(order)
        before, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        place = nth or "_nth"
        held = held if nth else held.withColumn(place, F.row_number().over(w))
        broken = {out: F.coalesce(F.max(F.when(~F.col(f"_flag_{out}"), F.col(place))).over(before), F.lit(0)) for out in looked}
        held = held.withColumns({f"_far_{out}": F.col(place) - broken[out] for out in looked})
        held = held.withColumns({f"_reached_{out}": F.count_if(F.col(f"_far_{out}") == rows).over(before) for out, rows in looked.items()})
        held = held.withColumns(
            {f"_ahead_{out}": F.coalesce(F.lead(f"_reached_{out}", rows - 1).over(w), F.last(f"_reached_{out}").over(whole)) for out, rows in looked.items()}
        )
        stays = {out: (F.col(f"_far_{out}") >= rows) | (F.col(f"_ahead_{out}") > F.col(f"_reached_{out}")) for out, rows in looked.items()}
        held = held.withColumns({out: F.col(f"_flag_{out}") & s for out, s in stays.items()})
        held = held.drop(*([] if nth else [place]), *(f"_{x}_{out}" for out in looked for x in ("flag", "far", "reached", "ahead")))
    for out, (_, rows) in flags.items():
        if rows > LOOK_AHEAD:
            held = _without(with_runs(held, f"_flag_{out}", keys, order).withColumn(out, F.col("_flag") & (F.col("_len") >= rows)))
        elif rows <= 1:
            held = held.withColumn(out, F.col(f"_flag_{out}"))
    return held.drop(*(f"_flag_{out}" for out in flags))


def close_gaps(df: DataFrame, flag: str | Column, gap: int, keys: Sequence[str], out: str, order: str = "frame") -> DataFrame:
    """The flag with holes filled whose two sides are up to gap rows apart."""
    runs = with_runs(df, flag, keys, order)
    session = Window.partitionBy(*keys)
    inner = (F.col("_run") > 0) & (F.col("_run") < F.max("_run").over(session))
    return _without(runs.withColumn(out, F.col("_flag") | (inner & (F.col("_len") + 1 <= gap))))


def bouts(df: DataFrame, flag: str | Column, keys: Sequence[str], order: str = "frame", most: Mapping[str, Column] | None = None) -> DataFrame:
    """Runs of true rows: (keys, start, end) in row positions, and the greatest
    value in each of the columns of most."""
    return scans.flag_runs(df, flag, keys, order, most=most).filter("flag").drop("flag")


def bout_count(df: DataFrame, flag: str, keys: Sequence[str], order: str = "frame") -> DataFrame:
    """Number of runs of true rows per key, 0 included."""
    return scans.flag_runs(df, flag, keys, order).groupBy(*keys).agg(F.count_if("flag").alias("n_bouts"))


def first_long_bout(df: DataFrame, flag: str | Column, rows: int, keys: Sequence[str], out: str, order: str = "frame") -> DataFrame:
    """(keys, out): position of the first run of at least rows true rows, 0
    where there is none."""
    long = F.when(F.col("flag") & (F.col("end") - F.col("start") + 1 >= rows), F.col("start"))
    return scans.flag_runs(df, flag, keys, order).groupBy(*keys).agg(F.coalesce(F.min(long), F.lit(0).cast("long")).alias(out))


def mask_to_bouts(df: DataFrame, flag: str, keys: Sequence[str], max_gap: int = MAX_FRAME_GAP) -> DataFrame:
    """Runs of true rows by frame number, split where frames jump by more than
    max_gap: (keys, start_frame, end_frame)."""
    found = scans.stitched_runs(df.filter(F.col(flag)), F.col("frame"), lambda a, b: b - a > max_gap, keys)
    return found.select(*keys, F.col("low").alias("start_frame"), F.col("high").alias("end_frame"))


def threshold_bouts(df: DataFrame, score: str | Column, grid: Sequence[float], keys: Sequence[str], order: str = "frame") -> DataFrame:
    """(keys, level, start, end): runs of rows with a score of at least grid[level],
    in row positions, for all thresholds at once.

    A row's height is the number of thresholds that it reaches. An episode of a
    threshold begins where the height rises past it and ends where it falls below:
    the rows give each end once, so that the work follows the number of episodes
    and not that of thresholds. The n-th beginning of a threshold in a session
    belongs to its n-th end. grid must rise; a null score reaches nothing.
    """
    if any(a >= b for a, b in pairwise(grid)):
        raise ValueError("thresholds must rise")
    value = F.col(score) if isinstance(score, str) else score
    steps = F.array(*(F.lit(float(g)) for g in grid))
    rows = df.select(*keys, F.col(order).alias("_o"), F.size(F.filter(steps, lambda g: value >= g)).alias("_v"))
    # runs of one height: their neighbours are the rows beside them
    flat = scans.stitched_runs(rows, F.col("_v"), lambda a, b: a != b, keys, "_o").withColumnRenamed("low", "_v")

    def edges(d: DataFrame, own: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*own).orderBy("start")
        return d.withColumns({"_before": F.coalesce(F.lag("_v").over(w), F.lit(0)), "_after": F.coalesce(F.lead("_v").over(w), F.lit(0))})

    around = scans.in_blocks(flat, keys, 1, edges, "start").select(*keys, "start", "end", "_v", "_before", "_after")
    sides = F.array(
        F.struct(F.lit("start").alias("side"), F.col("start").alias("pos"), F.col("_before").alias("from")),
        F.struct(F.lit("end").alias("side"), F.col("end").alias("pos"), F.col("_after").alias("from")),
    )
    each = around.withColumn("_s", F.explode(sides)).filter("_v > _s.from")
    each = each.withColumn("level", F.explode(F.expr("sequence(_s.from, _v - 1)")))
    nth = F.row_number().over(Window.partitionBy(*keys, "level", "_s.side").orderBy("_s.pos"))
    numbered = each.select(*keys, "level", F.col("_s.side").alias("_side"), F.col("_s.pos").alias("_pos"), nth.alias("_nth"))
    at = lambda side: F.max(F.when(F.col("_side") == side, F.col("_pos"))).alias(side)
    return numbered.groupBy(*keys, "level", "_nth").agg(at("start"), at("end")).drop("_nth")


def merge_close_bouts(df: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Bouts (start, end) of a key up to gap rows apart become one."""
    w = Window.partitionBy(*keys).orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("end").over(w) > gap).cast("int"), F.lit(0))
    out = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def join_episodes(
    df: DataFrame, flag: str, keys: Sequence[str], out: str, fps: float = 30.0, order: str = "frame",
    gap_sec: float = PAIR_RULE["gap_sec"], max_join: int = PAIR_RULE["max_join"],
) -> DataFrame:
    """The flag with holes shorter than gap_sec filled, at most max_join runs in
    a row; a hole that is too long or refused starts the count anew.

    Runs that short holes chain together are numbered; a hole is refused where
    the number is a multiple of max_join, which is what counting gives.
    """
    runs = with_runs(df, flag, keys, order)
    per_run = runs.groupBy(*keys, "_run").agg(F.first("_flag").alias("_flag"), F.first("_len").alias("_len"))
    w = Window.partitionBy(*keys).orderBy("_run")
    short = (F.lag("_len").over(w) + 1) / F.lit(fps) < gap_sec
    # a true run after a hole; the first run of a key has no hole before it
    episodes = per_run.withColumn("_chained", short & (F.col("_run") > 1)).filter("_flag")
    chain = F.sum((~F.coalesce("_chained", F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.partitionBy(*keys, "_chain").orderBy("_run")) - 1
    filled = episodes.withColumn("_chain", chain).withColumn("_place", place).filter(f"_place % {max_join} <> 0")
    filled = filled.select(*keys, (F.col("_run") - 1).alias("_run"), F.lit(True).alias("_fill"))
    return _without(
        runs.join(filled, [*keys, "_run"], "left").withColumn(out, F.col("_flag") | F.coalesce("_fill", F.lit(False)))
    ).drop("_fill")


def hysteresis(df: DataFrame, seed: str | Column, allowed: str | Column, keys: Sequence[str], out: str, order: str = "frame") -> DataFrame:
    """Runs of allowed rows that hold a seed row."""
    runs = with_runs(df.withColumn("_seed", seed if isinstance(seed, Column) else F.col(seed)), allowed, keys, order)
    born = F.bool_or("_seed").over(Window.partitionBy(*keys, "_run"))
    return _without(runs.withColumn(out, F.col("_flag") & F.coalesce(born, F.lit(False)))).drop("_seed")


def run_seconds(df: DataFrame, flag: str | Column, keys: Sequence[str], out: str, fps: float = 30.0, cap: float = 60.0, order: str = "frame") -> DataFrame:
    """Seconds for which the flag has held so far, capped; 0 where it is false."""
    held = _since_broken(df, flag, keys, order)
    return held.withColumn(out, F.when(F.col("_flag"), F.least(F.col("_far") / F.lit(fps), F.lit(cap))).otherwise(F.lit(0.0))).drop("_flag", "_far")


def encode_ranges(df: DataFrame, flag: str, keys: Sequence[str]) -> DataFrame:
    """A mask as text per key: first-last;first-last in frame numbers."""
    found = mask_to_bouts(df, flag, keys, 1).groupBy(*keys)
    listed = found.agg(F.sort_array(F.collect_list(F.struct("start_frame", "end_frame"))).alias("_r"))
    text = F.transform("_r", lambda r: F.concat_ws("-", r.start_frame.cast("string"), r.end_frame.cast("string")))
    return listed.select(*keys, F.array_join(text, ";").alias("ranges"))


def decode_ranges(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Intervals of a range text: (keys, start_frame, end_frame)."""
    one = df.filter(F.nullif(F.col(column), F.lit("")).isNotNull()).select(*keys, F.explode(F.split(column, ";")).alias("_r"))
    ends = F.split("_r", "-")
    return one.select(*keys, ends[0].cast("long").alias("start_frame"), ends[1].cast("long").alias("end_frame"))


def seen_intervals(progress: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What was watched: the ranges in seen, else everything up to watched_until."""
    ranged = decode_ranges(progress, "seen", keys)
    rest = progress.filter(F.nullif(F.col("seen"), F.lit("")).isNull() & F.col("watched_until").isNotNull())
    return ranged.unionByName(rest.select(*keys, F.lit(0).cast("long").alias("start_frame"), F.col("watched_until").cast("long").alias("end_frame")))


def touching(bouts_: DataFrame, others: DataFrame, keys: Sequence[str], how: str, margin: int = 0) -> DataFrame:
    """Bouts that meet (left_semi) or don't meet (left_anti) a bout of others, or
    come within margin of one."""
    own = bouts_.select(*keys, "start", "end").distinct()
    right = others.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = dyadic.meeting(own, right, keys, margin=margin).select(*keys, "start", "end").distinct()
    return bouts_.join(hit, [*keys, "start", "end"], how)
