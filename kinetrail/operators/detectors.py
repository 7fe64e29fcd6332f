"""Rule detectors on kinematics and the summaries built on them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import head_direction, length
from ..sources.scratch import written
from .intervals import bouts, close_gaps, hysteresis, join_episodes, mask_to_bouts, merge_close_bouts, sustained, sustained_each, threshold_bouts, touching
from .scans import running_sum
from .timeseries import KEYS, middle_of, moved, over, smoothed, straightness_parts

#: Fixed value: seconds of the rolling median that a detector reads.
SMOOTH_SEC = 0.3
#: Rows that triage() and movement_rows(), kinematics included, look back or ahead
#: at most with their defaults (4 s): what scans.in_blocks() has to know.
REACH = C.rows_of(4.0)


def _speeds(keypoints: Sequence[str]) -> list[Column]:
    return [F.col(f"speed_{k}") for k in keypoints]


def pose_valid(keypoints: Sequence[str] = C.KEYPOINTS) -> Column:
    """At least one keypoint has a speed."""
    return F.coalesce(*_speeds(keypoints)).isNotNull()


def _rows(seconds: float, fps: float) -> int:
    return max(1, C.rows_of(seconds, fps))


def _sustain(df: DataFrame, flag: Column, seconds: float, fps: float, keys: Sequence[str], out: str) -> DataFrame:
    df = df.withColumn(f"_{out}", flag)
    return sustained(df, f"_{out}", C.rows_of(seconds, fps), keys, out).drop(f"_{out}")


@dataclass
class _Part:
    """What a detector asks for: columns from a row and the one before, columns
    made of those, medians and other windows of these, its flag, and the rows of
    its shortest run."""

    flag: Column
    rows: int
    before: dict[str, Column] = field(default_factory=dict)
    made: dict[str, Column] = field(default_factory=dict)
    medians: dict[str, tuple[str, int]] = field(default_factory=dict)
    around: dict[str, Column] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [*self.before, *self.made, *self.medians, *self.around]


def _looked(df: DataFrame, parts: Sequence[_Part], keys: Sequence[str], more: Mapping[str, Column] | None = None) -> DataFrame:
    """df with the columns of several detectors, whose windows are shared."""
    joint = lambda name: {k: v for p in parts for k, v in getattr(p, name).items()}
    df = df.withColumns(joint("before")) if joint("before") else df
    df = df.withColumns(joint("made")) if joint("made") else df
    return smoothed(df, joint("medians"), keys, joint("around") | dict(more or {}))


def _detect(df: DataFrame, part: _Part, keys: Sequence[str], out: str) -> DataFrame:
    df = _looked(df, [part], keys)
    return sustained_each(df, {out: (part.flag, part.rows)}, keys).drop(*part.columns())


def _walking(
    fps: float, keys: Sequence[str], speed: float = C.WALKING_SPEED, seconds: float = 0.5, straight: float = 0.3, straight_sec: float = 1.0,
    smooth_sec: float = SMOOTH_SEC,
) -> _Part:
    around, straightness = straightness_parts("posx_body", "posy_body", straight_sec, fps, keys)
    fast = F.coalesce(F.col("_w_speed"), F.lit(0.0)) >= speed
    going = F.coalesce(straightness, F.lit(1.0)) >= straight
    return _Part(
        fast & going, C.rows_of(seconds, fps), before={"_step": moved("posx_body", "posy_body", keys)},
        medians={"_w_speed": ("speed_body", _rows(smooth_sec, fps))}, around=around,
    )


def detect_walking(
    df: DataFrame, fps: float = C.FPS, keys: Sequence[str] = KEYS, speed: float = C.WALKING_SPEED, seconds: float = 0.5,
    straight: float = 0.3, straight_sec: float = 1.0, smooth_sec: float = SMOOTH_SEC,
) -> DataFrame:
    """Fast, and going somewhere: unknown speed is no walking, unknown
    straightness no objection."""
    return _detect(df, _walking(fps, keys, speed, seconds, straight, straight_sec, smooth_sec), keys, "walking")


def _freezing(
    fps: float, keys: Sequence[str], speed: float = 9.0, seconds: float = 1.0, smooth_sec: float = SMOOTH_SEC, keypoints: Sequence[str] = C.KEYPOINTS
) -> _Part:
    slow = F.coalesce(F.col("_f_typical") <= speed, F.lit(False))
    made = {"_typical": middle_of(_speeds(keypoints)), "_f_valid": pose_valid(keypoints)}
    return _Part(F.col("_f_valid") & slow, C.rows_of(seconds, fps), made=made, medians={"_f_typical": ("_typical", _rows(smooth_sec, fps))})


def detect_freezing(
    df: DataFrame, fps: float = C.FPS, keys: Sequence[str] = KEYS, speed: float = 9.0, seconds: float = 1.0,
    smooth_sec: float = SMOOTH_SEC, keypoints: Sequence[str] = C.KEYPOINTS,
) -> DataFrame:
    """The median keypoint hardly moves; rows without pose are not freezing."""
    return _detect(df, _freezing(fps, keys, speed, seconds, smooth_sec, keypoints), keys, "freezing")


def object_exploration(
    df: DataFrame, objects: DataFrame, fps: float = C.FPS, keys: Sequence[str] = KEYS, margin: float = 12.0, angle: float = 180.0,
    seconds: float = 0.3,
) -> DataFrame:
    """(keys, object_id, frame, exploring): the nose in an object's zone, on
    coordinates of any confidence; objects: session_id, object_id, circle."""
    own = objects.select("session_id", "object_id", "center_x", "center_y", "radius")
    each = df.join(own, "session_id")
    to_x, to_y = F.col("center_x") - F.col("nose_x"), F.col("center_y") - F.col("nose_y")
    near = length(to_x, to_y) <= F.col("radius") + margin
    if angle < 180.0:
        hx, hy = head_direction()
        cosine = (hx * to_x + hy * to_y) / F.nullif(length(hx, hy) * length(to_x, to_y), F.lit(0.0))
        near = near & (F.coalesce(cosine, F.lit(-1.0)) >= math.cos(math.radians(angle)))
    found = _sustain(each, near, seconds, fps, [*keys, "object_id"], "exploring")
    return found.select(*keys, "object_id", "frame", "exploring")


def with_objects(df: DataFrame, objects: DataFrame) -> DataFrame:
    """Adds _objects, the circles of the session, of which there are few."""
    listed = objects.groupBy("session_id").agg(F.collect_list(F.struct("center_x", "center_y", "radius")).alias("_objects"))
    return df.join(listed, "session_id", "left")


def _near_objects(margin: float, angle: float) -> Column:
    """Places in _objects of those that the nose is near."""
    hx, hy = head_direction()

    def near(o: Column) -> Column:
        to_x, to_y = o["center_x"] - F.col("nose_x"), o["center_y"] - F.col("nose_y")
        inside = length(to_x, to_y) <= o["radius"] + margin
        if angle < 180.0:
            cosine = (hx * to_x + hy * to_y) / F.nullif(length(hx, hy) * length(to_x, to_y), F.lit(0.0))
            inside = inside & (F.coalesce(cosine, F.lit(-1.0)) >= math.cos(math.radians(angle)))
        return inside

    none = F.array().cast("array<int>")
    return F.coalesce(F.array_compact(F.transform("_objects", lambda o, i: F.when(near(o), i))), none)


def _explored(
    fps: float, keys: Sequence[str], margin: float = 12.0, angle: float = 180.0, seconds: float = 0.3
) -> tuple[_Part, Column]:
    """The flag of rows that end an exploration, and the exploration made of it."""
    rows, w = _rows(seconds, fps), over(keys)
    last, next_ = w.rowsBetween(1 - rows, 0), w.rowsBetween(0, rows - 1)
    around = {"_n_rows": F.count(F.lit(1)).over(last), "_n_near": F.min(F.size("_near")).over(last), "_all": F.collect_list("_near").over(last)}
    common = F.aggregate("_all", F.get("_all", 0), F.array_intersect)
    ends = F.when((F.col("_n_rows") == rows) & (F.col("_n_near") > 0), F.size(common) > 0).otherwise(F.lit(False))
    return _Part(ends, rows, made={"_near": _near_objects(margin, angle)}, around=around), F.bool_or("_ends").over(next_)


def detect_object_interaction(
    df: DataFrame, objects: DataFrame | None, fps: float = C.FPS, keys: Sequence[str] = KEYS, margin: float = 12.0, angle: float = 180.0,
    seconds: float = 0.3,
) -> DataFrame:
    """Exploration of any object, as object_exploration() has it, without a row per
    object: an object that is near in each of the last rows ends an exploration,
    and so are the rows before explored. objects: none if df has _objects."""
    df = df if objects is None else with_objects(df, objects)
    part, explored = _explored(fps, keys, margin, angle, seconds)
    df = _looked(df, [part], keys).withColumn("_ends", part.flag).withColumn("object_interaction", explored)
    return df.drop("_ends", "_objects", *part.columns())


def _low_activity(
    fps: float, keys: Sequence[str], speed: float = C.WALKING_SPEED, seconds: float = 0.5, smooth_sec: float = SMOOTH_SEC,
    keypoints: Sequence[str] = C.KEYPOINTS,
) -> _Part:
    slow = F.coalesce(F.col("_l_speed") < speed, F.lit(False))
    return _Part(
        F.col("_l_valid") & slow & ~F.col("freezing"), C.rows_of(seconds, fps), made={"_l_valid": pose_valid(keypoints)},
        medians={"_l_speed": ("speed_body", _rows(smooth_sec, fps))},
    )


def detect_low_activity(
    df: DataFrame, fps: float = C.FPS, keys: Sequence[str] = KEYS, speed: float = C.WALKING_SPEED, seconds: float = 0.5,
    smooth_sec: float = SMOOTH_SEC, keypoints: Sequence[str] = C.KEYPOINTS,
) -> DataFrame:
    """Slow but not freezing; needs the column freezing."""
    return _detect(df, _low_activity(fps, keys, speed, seconds, smooth_sec, keypoints), keys, "low_activity")


def _active_head(
    fps: float, keys: Sequence[str], speed: float = 12.0, body_speed: float = 12.0, seconds: float = 0.5, smooth_sec: float = 0.5
) -> _Part:
    rows, w = _rows(smooth_sec, fps), over(keys)
    # the neck as seen from the body, by the row before of each
    step = lambda a: F.col(f"pos{a}_neck") - F.col(f"pos{a}_body") - (F.lag(f"pos{a}_neck").over(w) - F.lag(f"pos{a}_body").over(w))
    busy = F.coalesce(F.col("_h_head"), F.lit(0.0)) >= speed
    rest = F.coalesce(F.col("_h_body") < body_speed, F.lit(False))
    return _Part(
        busy & rest & ~F.col("object_interaction"), C.rows_of(seconds, fps), before={"_hx": step("x"), "_hy": step("y")},
        made={"_head": length(F.col("_hx"), F.col("_hy")) * fps}, medians={"_h_head": ("_head", rows), "_h_body": ("speed_body", rows)},
    )


def detect_active_head(
    df: DataFrame, fps: float = C.FPS, keys: Sequence[str] = KEYS, speed: float = 12.0, body_speed: float = 12.0, seconds: float = 0.5,
    smooth_sec: float = 0.5,
) -> DataFrame:
    """The neck moves against a resting body, away from objects; needs the
    column object_interaction."""
    return _detect(df, _active_head(fps, keys, speed, body_speed, seconds, smooth_sec), keys, "active_head")


def triage(
    df: DataFrame, objects: DataFrame | None, fps: float = C.FPS, keys: Sequence[str] = KEYS, settings: Mapping[str, Mapping[str, float]] | None = None
) -> DataFrame:
    """All detectors; review is what no routine claims or the head flags, where
    there is a pose. settings: other parameters of a detector by its column."""
    own = lambda name: (settings or {}).get(name, {})
    df = df if objects is None else with_objects(df, objects)
    walking, freezing = _walking(fps, keys, **own("walking")), _freezing(fps, keys, **own("freezing"))
    low, head = _low_activity(fps, keys, **own("low_activity")), _active_head(fps, keys, **own("active_head"))
    near, explored = _explored(fps, keys, **own("object_interaction"))
    parts = [walking, freezing, near, low, head]
    df = _looked(df, parts, keys, {"_nth": F.row_number().over(over(keys))}).withColumn("_ends", near.flag).withColumn("object_interaction", explored)
    df = sustained_each(df, {"freezing": (freezing.flag, freezing.rows), "walking": (walking.flag, walking.rows)}, keys, nth="_nth")
    df = sustained_each(df, {"low_activity": (low.flag, low.rows), "active_head": (head.flag, head.rows)}, keys, nth="_nth")
    df = df.drop("_nth", "_ends", "_objects", *(c for p in parts for c in p.columns()))
    df = df.withColumn("low_activity", F.col("low_activity") & ~F.col("active_head")).withColumn("unscorable", ~pose_valid())
    claimed = F.col("walking") | F.col("freezing") | F.col("low_activity") | F.col("object_interaction")
    return df.withColumn("review", (~claimed | F.col("active_head")) & ~F.col("unscorable"))


def movement_rows(
    df: DataFrame, objects: DataFrame | None, fps: float = C.FPS, keys: Sequence[str] = KEYS, speed: float = C.WALKING_SPEED, smooth_sec: float = SMOOTH_SEC
) -> DataFrame:
    """Position, speed, moving, still, freezing, unscorable, exploring, and the
    step that the smoothed position has made."""
    rows = _rows(smooth_sec, fps)
    df = df if objects is None else with_objects(df, objects)
    freezing, (near, explored) = _freezing(fps, keys), _explored(fps, keys)
    moving = _Part(
        pose_valid() & (F.coalesce(F.col("speed"), F.lit(0.0)) >= speed), C.rows_of(C.MOVING_SEC, fps),
        medians={"x": ("posx_body", rows), "y": ("posy_body", rows), "speed": ("speed_body", rows)},
    )
    df = _looked(df, [freezing, near, moving], keys, {"_nth": F.row_number().over(over(keys))})
    df = df.withColumn("_ends", near.flag).withColumn("object_interaction", explored)
    df = sustained_each(df, {"freezing": (freezing.flag, freezing.rows), "moving": (moving.flag, moving.rows)}, keys, nth="_nth")
    df = df.drop("_nth", "_ends", "_objects", *freezing.columns(), *near.columns())
    df = df.withColumn("unscorable", ~pose_valid()).withColumn("still", ~F.col("unscorable") & ~F.col("moving"))
    return df.withColumn("_step", moved("x", "y", keys)).withColumn("exploring", F.col("object_interaction"))


#: Columns of a movement layer besides keys and distance.
LAYER = ("frame", "time_ms", "x", "y", "speed", "moving", "still", "freezing", "unscorable", "exploring")


def movement_layer(
    df: DataFrame, objects: DataFrame | None, fps: float = C.FPS, keys: Sequence[str] = KEYS, speed: float = C.WALKING_SPEED, smooth_sec: float = SMOOTH_SEC
) -> DataFrame:
    """movement_rows() with the distance so far."""
    return layer_of(movement_rows(df, objects, fps, keys, speed, smooth_sec), keys)


def layer_of(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The layer of movement_rows(), which are written once: the distance reads
    them twice."""
    return cumulative_distance(written(rows.select(*keys, *LAYER, "_step"), "movement"), keys)


def cumulative_distance(df: DataFrame, keys: Sequence[str] = KEYS, step: str = "_step", most: float = C.MAX_STEP_PX) -> DataFrame:
    """distance: sum so far of the steps made while moving, jumps left out."""
    counted = F.when(F.col("moving") & (F.col(step) <= most), F.col(step)).otherwise(F.lit(0.0))
    return running_sum(df, counted, keys, "distance").drop(step)


def session_summary(layer: DataFrame, fps: float = C.FPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per session of a movement layer."""
    w = Window.partitionBy(*keys).orderBy("frame")
    rise = F.col("exploring") & ~F.coalesce(F.lag("exploring").over(w), F.lit(False))
    pct = lambda c: F.round(100 * F.avg(F.col(c).cast("double")), 1).alias(f"{c}_pct")
    return layer.withColumn("_rise", rise.cast("long")).groupBy(*keys).agg(
        F.round(F.count(F.lit(1)) / F.lit(fps), 1).alias("duration_s"),
        *(pct(c) for c in ("moving", "still", "freezing", "unscorable")),
        F.round(F.max("distance"), 0).alias("distance_px"),
        F.round(F.coalesce(F.percentile(F.when(F.col("moving"), F.col("speed")), F.lit(0.5)), F.lit(0.0)), 1).alias("speed_moving_px_s"),
        F.round(F.sum(F.col("exploring").cast("long")) / F.lit(fps), 1).alias("exploration_total_s"),
        F.sum("_rise").alias("exploration_bouts"),
    )


def review_segments(triaged: DataFrame, keys: Sequence[str] = KEYS, fps: float = C.FPS, merge_sec: float = 1.0, max_gap: int = C.MAX_FRAME_GAP) -> DataFrame:
    """Stretches for the reviewer with times, close ones merged."""
    found = mask_to_bouts(triaged, "review", keys, max_gap).withColumnsRenamed({"start_frame": "start", "end_frame": "end"})
    merged = merge_close_bouts(found, keys, C.rows_of(merge_sec, fps))
    times = triaged.select(*keys, "frame", "time_ms")
    first = times.withColumnsRenamed({"frame": "start", "time_ms": "start_ms"})
    last = times.withColumnsRenamed({"frame": "end", "time_ms": "end_ms"})
    out = merged.join(first, [*keys, "start"], "left").join(last, [*keys, "end"], "left")
    return out.select(*keys, F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), "start_ms", "end_ms", (F.col("end") - F.col("start") + 1).alias("n_frames"))


def frame_mask(df: DataFrame, score: str, threshold: float, out: str, low: float | None = None, fps: float = C.FPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Frame scores to a mask: one threshold, or hysteresis with low, then the
    shortest duration."""
    mask = F.col(score) >= threshold
    if low is not None and low < threshold:
        df = hysteresis(df, mask, F.col(score) >= low, keys, f"_{out}")
    else:
        df = df.withColumn(f"_{out}", mask)
    return sustained(df, f"_{out}", C.rows_of(C.MIN_BOUT_SEC, fps), keys, out).drop(f"_{out}")


def threshold_episodes(
    df: DataFrame, score: str, grid: Sequence[float], keys: Sequence[str] = KEYS, fps: float = C.FPS, behavior: str = "rearing",
    min_sec: float = C.MIN_BOUT_SEC,
) -> DataFrame:
    """(keys, level, start, end): what frame_mask() and gate() give at every
    threshold of a grid at once, on episodes in place of masks. Not for grooming,
    which needs the frames that freeze."""
    if behavior == "grooming":
        raise ValueError("grooming is vetoed by frames: use gate()")
    found = threshold_bouts(df, score, grid, keys).filter(F.col("end") - F.col("start") + 1 >= _rows(min_sec, fps))
    return merge_close_bouts(found, [*keys, "level"], C.rows_of(C.MERGE_GAP_SEC.get(behavior, 0.0), fps))


def drop_short(df: DataFrame, flag: str, out: str, fps: float = C.FPS, keys: Sequence[str] = KEYS, seconds: float = C.PAIR_RULE["min_sec"]) -> DataFrame:
    return sustained(df, flag, C.rows_of(seconds, fps), keys, out)


def gate(df: DataFrame, mask: str, behavior: str, out: str, fps: float = C.FPS, rule: str = "gap", keys: Sequence[str] = KEYS) -> DataFrame:
    """The final rules of a behaviour: join holes, no grooming while freezing,
    the shortest duration, and the pair rule's minimum."""
    if behavior == "rearing" and rule == "pair":
        df = join_episodes(df, mask, keys, "_joined", fps)
    else:
        df = close_gaps(df, mask, C.rows_of(C.MERGE_GAP_SEC.get(behavior, 0.0), fps), keys, "_joined")
    if behavior == "grooming":
        df = df.withColumn("_joined", F.col("_joined") & ~F.col("freezing"))
    df = sustained(df, "_joined", C.rows_of(C.MIN_BOUT_SEC, fps), keys, out).drop("_joined")
    return drop_short(df, out, out, fps, keys) if behavior == "rearing" and rule == "pair" else df


def triage_episodes(df: DataFrame, score: str, low: float, high: float, cut: float | None = None, behavior: str = "rearing", fps: float = C.FPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, start, end, peak, accepted): episodes at cut, and weak ones at low
    that meet none of them; accepted from a peak of high on. The peaks come with
    the episodes."""

    def found(threshold: float) -> DataFrame:
        gated = gate(frame_mask(df, score, threshold, "_m", None, fps, keys), "_m", behavior, "_g", fps, "gap", keys)
        return bouts(gated, "_g", keys, most={"peak": F.col(score)})

    if cut is None:
        episodes = found(low).withColumn("_weak", F.lit(False))
    else:
        main = found(cut)
        episodes = main.withColumn("_weak", F.lit(False)).unionByName(
            touching(found(low), main, keys, "left_anti").withColumn("_weak", F.lit(True))
        )
    return episodes.withColumn("accepted", ~F.col("_weak") & (F.col("peak") >= high)).drop("_weak")
