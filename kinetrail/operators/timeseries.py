"""Time series of a session: kinematics, windows, signals.

Frames of a (session, field) are ordered by frame; every window spec has these
keys, so that one exchange and one sort serve a chain of these operators.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.scalars import confident, detected, floor_distance, length, point_distances
from .intervals import run_seconds

KEYS = ("session_id", "field")


def over(keys: Sequence[str] = KEYS, order: str = "frame") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def centred(rows: int, keys: Sequence[str] = KEYS) -> WindowSpec:
    """A centred frame of rows rows; of an even number the later half is shorter."""
    return over(keys).rowsBetween(-(rows // 2), (rows - 1) // 2)


#: Rows of a rolling median up to which its values are listed and sorted per row.
MEDIAN_LIST = 64


def smooth(value: Column | str, rows: int, keys: Sequence[str] = KEYS) -> Column:
    """Centred rolling median over what is not null.

    The few values of a window are listed and sorted, in one short expression: the
    percentile aggregate builds a hash map per row, and a column per neighbour
    makes generated methods too long for the JVM to compile.
    """
    value = F.col(value) if isinstance(value, str) else value
    if rows <= 1:
        return value
    if rows > MEDIAN_LIST:
        return F.percentile(value, F.lit(0.5)).over(centred(rows, keys))
    return _middle(F.sort_array(F.collect_list(value).over(centred(rows, keys))))


def smoothed(df: DataFrame, values: Mapping[str, tuple[str, int]], keys: Sequence[str] = KEYS, more: Mapping[str, Column] | None = None) -> DataFrame:
    """df with smooth() of a column over a number of rows, by the new name. A list is
    a column before its middle is taken: where an expression names a window
    function several times, it is evaluated as often. more: other window columns,
    taken along in the same pass."""
    short = {(c, rows) for c, rows in values.values() if 1 < rows <= MEDIAN_LIST}
    lists = {f"_list_{c}_{rows}": F.collect_list(c).over(centred(rows, keys)) for c, rows in sorted(short)}
    long = {out: smooth(c, rows, keys) for out, (c, rows) in values.items() if (c, rows) not in short}
    df = df.withColumns(lists | long | dict(more or {}))
    return df.withColumns({out: _middle(F.sort_array(f"_list_{c}_{rows}")) for out, (c, rows) in values.items() if (c, rows) in short}).drop(*lists)


def _middle(found: Column) -> Column:
    return (F.get(found, F.shiftright(F.size(found) - 1, 1)) + F.get(found, F.shiftright(F.size(found), 1))) / 2


def moved(x: Column | str, y: Column | str, keys: Sequence[str] = KEYS) -> Column:
    """Distance to the previous row; null on the first."""
    w = over(keys)
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    return length(x - F.lag(x).over(w), y - F.lag(y).over(w))


def frame_kinematics(
    pose: DataFrame, keypoints: Sequence[str] = C.KEYPOINTS, fps: float = C.FPS, threshold: float = C.CONFIDENCE,
    keys: Sequence[str] = KEYS, distances: bool = True,
) -> DataFrame:
    """Adds posx_, posy_ (masked by confidence), speed_ per keypoint in px/s and
    the pair distances."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    masked = {}
    for k in keypoints:
        masked[f"posx_{k}"] = confident(f"{k}_x", f"{k}_p", threshold)
        masked[f"posy_{k}"] = confident(f"{k}_y", f"{k}_p", threshold)
    out = pose.withColumns(masked)
    speeds = {f"speed_{k}": moved(f"posx_{k}", f"posy_{k}", keys) * F.lit(fps) for k in keypoints}
    return out.withColumns(speeds | (point_distances(keypoints) if distances else {}))


def window_features(df: DataFrame, signals: Sequence[str], seconds: Sequence[float], fps: float = C.FPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """mean, std (n - 1), min and max of every signal over centred windows; all
    statistics of a window length share its frame."""
    found = {}
    for s in seconds:
        rows = max(1, C.rows_of(s, fps))
        w = centred(rows, keys)
        for c in signals:
            for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                found[f"{c}_w{rows}_{name}"] = f(c).over(w)
    return df.withColumns(found)


def straightness_parts(x: str, y: str, seconds: float = 1.0, fps: float = C.FPS, keys: Sequence[str] = KEYS, step: str = "_step", prefix: str = "_p") -> tuple[dict[str, Column], Column]:
    """path_straightness() as window columns by name, and what it is of them."""
    half, w = max(1, C.rows_of(seconds / 2, fps)), over(keys)
    around = w.rowsBetween(-half, half)
    found = {
        "n": F.count(step).over(around), "path": F.sum(step).over(around), "x1": F.lag(x, half).over(w), "x2": F.lead(x, half).over(w),
        "y1": F.lag(y, half).over(w), "y2": F.lead(y, half).over(w),
    }
    p = lambda name: F.col(f"{prefix}_{name}")
    net = length(p("x2") - p("x1"), p("y2") - p("y1"))
    return {f"{prefix}_{k}": v for k, v in found.items()}, F.when((p("n") >= half) & (p("path") > 0), net / p("path"))


def path_straightness(x: Column | str, y: Column | str, seconds: float = 1.0, fps: float = C.FPS, keys: Sequence[str] = KEYS, step: str = "_step") -> Column:
    """Net displacement over path length around a row; step names the column of
    moved(x, y). Null without a full window, without enough steps or path."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    half, w = max(1, C.rows_of(seconds / 2, fps)), over(keys)
    around = w.rowsBetween(-half, half)
    path = F.when(F.count(step).over(around) >= half, F.sum(step).over(around))
    net = length(F.lead(x, half).over(w) - F.lag(x, half).over(w), F.lead(y, half).over(w) - F.lag(y, half).over(w))
    return F.when(path > 0, net / path)


def interpolate_skipped(pose: DataFrame, keypoints: Sequence[str], inferred: str, threshold: float = C.CONFIDENCE, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows without inference get the line between their neighbours with one,
    where both are confident, else -1, -1, 0; rows after the last repeat it."""
    w = over(keys)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    got = F.col(inferred)
    names = ["frame", *(f"{k}_{a}" for k in keypoints for a in "xyp")]
    ends = {f"_a_{n}": F.last(F.when(got, F.col(n)), ignorenulls=True).over(before) for n in names}
    ends |= {f"_b_{n}": F.first(F.when(got, F.col(n)), ignorenulls=True).over(after) for n in names}
    out = pose.withColumns(ends)
    share = (F.col("frame") - F.col("_a_frame")) / (F.col("_b_frame") - F.col("_a_frame"))
    made = {}
    for k in keypoints:
        sure = (F.col(f"_a_{k}_p") >= threshold) & (F.col(f"_b_{k}_p") >= threshold)
        for a, lost in (("x", -1.0), ("y", -1.0), ("p", 0.0)):
            start, end = F.col(f"_a_{k}_{a}"), F.col(f"_b_{k}_{a}")
            between = F.when(sure, start + share * (end - start)).otherwise(F.lit(lost))
            made[f"{k}_{a}"] = (
                F.when(got, F.col(f"{k}_{a}")).when(F.col("_b_frame").isNull(), start).when(F.col("_a_frame").isNull(), F.lit(lost)).otherwise(between)
            )
    return out.withColumns(made).drop(*ends)


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a session. What a session has in all is a window over it, in the order
    that the rows have, so that what leads to them is worked out once."""
    return reduce(lambda d, k: d.filter(F.col(k).isNotNull()), keys, df)


def relative_to_session(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Columns divided by the session's median; null where it is not positive."""
    session = Window.partitionBy(*keys)
    joined = _keyed(df, keys).withColumns({f"_m_{c}": F.percentile(c, F.lit(0.5)).over(session) for c in columns})
    return joined.withColumns({c: F.when(F.col(f"_m_{c}") > 0, F.col(c) / F.col(f"_m_{c}")) for c in columns}).drop(
        *(f"_m_{c}" for c in columns)
    )


def middle_of(values: Sequence[Column]) -> Column:
    """Median of the values of a row that are not null. Sorted, the nulls come
    first; without values both places hold none."""
    found = F.sort_array(F.array(*values))
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    first = F.lit(len(values)) - n
    return (F.get(found, first + F.shiftright(n - 1, 1)) + F.get(found, first + F.shiftright(n, 1))) / 2


def with_object_distance(df: DataFrame, objects: DataFrame, x: str, y: str, out: str, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Distance from a point to the nearest object's edge; without objects in
    the session NO_OBJECT_DISTANCE. Objects become one array per session."""
    listed = objects.groupBy(*keys).agg(F.collect_list(F.struct("center_x", "center_y", "radius")).alias("_objects"))
    joined = df.join(listed, list(keys), "left")
    edge = F.transform("_objects", lambda o: length(o.center_x - F.col(x), o.center_y - F.col(y)) - o.radius)
    return joined.withColumn(out, F.when(F.col("_objects").isNull(), F.lit(C.NO_OBJECT_DISTANCE)).otherwise(F.array_min(edge))).drop("_objects")


def frame_signals(kinematics: DataFrame, objects: DataFrame, fps: float = C.FPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds the signals that windows describe; kinematics must have passed
    frame_kinematics() and, for the rule_ columns, triage()."""
    c, w = F.col, over(keys)
    px = {k: (c(f"posx_{k}"), c(f"posy_{k}")) for k in C.KEYPOINTS}
    ear = tuple((a + b) / 2 for a, b in zip(px["ear_left"], px["ear_right"], strict=True))
    heading = F.atan2(px["nose"][1] - ear[1], px["nose"][0] - ear[0])
    df = kinematics.withColumns(
        {
            "_heading": heading, "_step": moved("posx_body", "posy_body", keys),
            "_hx": px["neck"][0] - px["body"][0], "_hy": px["neck"][1] - px["body"][1],
            "_nx": px["nose"][0] - px["neck"][0], "_ny": px["nose"][1] - px["neck"][1],
        }
    )
    turn = c("_heading") - F.lag("_heading").over(w)
    ax, ay = px["body"][0] - px["tail_base"][0], px["body"][1] - px["tail_base"][1]
    bx, by = c("_hx"), c("_hy")
    between = lambda a, b: length(px[a][0] - px[b][0], px[a][1] - px[b][1])
    df = df.withColumns(
        {
            "body_speed": c("speed_body"),
            "typical_speed": middle_of([c(f"speed_{k}") for k in C.KEYPOINTS]),
            "head_speed": moved("_hx", "_hy", keys) * fps,
            "nose_speed": moved("_nx", "_ny", keys) * fps,
            "head_turn": F.degrees(F.abs(F.atan2(F.sin(turn), F.cos(turn)))) * fps,
            "body_length": between("neck", "tail_base"),
            "full_length": between("nose", "tail_base"),
            "ear_span": between("ear_left", "ear_right"),
            "bend": F.degrees(F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by))),
            "straightness": path_straightness("posx_body", "posy_body", 1.0, fps, keys),
            "body_x": c("posx_body"),
            "body_y": c("posy_body"),
        }
        | {f"conf_{k}": c(f"{k}_p") for k in C.KEYPOINTS}
    )
    df = relative_to_session(df, ["body_length", "full_length", "ear_span"], keys)
    df = with_object_distance(df, objects, "posx_nose", "posy_nose", "object_distance")
    return with_wall_distance(df, keys).drop("_heading", "_step", "_hx", "_hy", "_nx", "_ny")


def with_wall_distance(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distance of the neck from the rectangle of the body's 1st and 99th
    percentiles."""
    session, ends = Window.partitionBy(*keys), F.array(F.lit(0.01), F.lit(0.99))
    boxed = _keyed(df, keys).withColumns({"_bx": F.percentile("posx_body", ends).over(session), "_by": F.percentile("posy_body", ends).over(session)})
    x, y, bx, by = F.col("posx_neck"), F.col("posy_neck"), F.col("_bx"), F.col("_by")
    away = F.when(x.isNotNull() & y.isNotNull(), F.least(x - bx[0], bx[1] - x, y - by[0], by[1] - y))
    return boxed.withColumn("wall_distance", away).drop("_bx", "_by")


def with_floor(df: DataFrame, floors: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """wall_distance of the neck and nose_floor from a marked floor polygon.

    floors: keys and polygon, an array of corners (x, y) in order.
    """
    point = lambda k, a: confident(f"{k}_{a}", f"{k}_p")
    return (
        df.join(floors, list(keys), "left")
        .withColumn("wall_distance", floor_distance(point("neck", "x"), point("neck", "y"), F.col("polygon")))
        .withColumn("nose_floor", floor_distance(point("nose", "x"), point("nose", "y"), F.col("polygon")))
        .drop("polygon")
    )


def pose_rise(kinematics: DataFrame, fps: float = C.FPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """neck_rel_y, nose_rel_y over the session's body length; length_local over
    the median of the 5 s around, from one second of values on."""
    c = F.col
    df = _keyed(kinematics, keys).withColumn("_length", length(c("posx_neck") - c("posx_tail_base"), c("posy_neck") - c("posy_tail_base")))
    typical = F.percentile("_length", F.lit(0.5)).over(Window.partitionBy(*keys))
    w = centred(C.rows_of(5, fps), keys)
    local = F.when(F.count("_length").over(w) >= int(fps), F.percentile("_length", F.lit(0.5)).over(w))
    return (
        df.withColumn("length_local", c("_length") / local)
        .withColumn("_typical", typical)
        .withColumn("neck_rel_y", (c("posy_neck") - c("posy_body")) / c("_typical"))
        .withColumn("nose_rel_y", (c("posy_nose") - c("posy_body")) / c("_typical"))
        .drop("_length", "_typical")
    )


def dwell_signals(signals: DataFrame, fps: float = C.FPS, keys: Sequence[str] = KEYS, walking: float = C.WALKING_SPEED) -> DataFrame:
    """still_sec and wall_sec; a row without pose does not end stillness."""
    speed = smooth("body_speed", C.rows_of(0.5, fps), keys)
    df = signals.withColumn("_still", ~(F.coalesce(speed, F.lit(0.0)) > walking))
    df = df.withColumn("_wall", F.coalesce(F.col("wall_distance") < C.WALL_PX, F.lit(False)))
    df = run_seconds(df, "_still", keys, "still_sec", fps, C.DWELL_CAP_SEC)
    return run_seconds(df, "_wall", keys, "wall_sec", fps, C.DWELL_CAP_SEC).drop("_still", "_wall")


#: Statistics per signal.
SPEC: dict[str, tuple[str, ...]] = {
    "body_speed": ("median", "p90"),
    "typical_speed": ("median", "p90"),
    "head_speed": ("median", "p90"),
    "nose_speed": ("median", "p90"),
    "head_turn": ("median", "p90"),
    "body_length": ("median", "p10", "std"),
    "full_length": ("median", "p10", "std"),
    "ear_span": ("median", "std"),
    "bend": ("median", "p90"),
    "straightness": ("median", "p10"),
    "body_x": ("std",),
    "body_y": ("std",),
    "object_distance": ("p10", "median"),
    "wall_distance": ("p10", "median"),
    **{f"conf_{k}": ("mean", "p10") for k in C.KEYPOINTS},
    **{f"rule_{k}": ("mean",) for k in C.RULES},
}
#: Statistics of signals that not every session has.
EXTRA_SPEC: dict[str, tuple[str, ...]] = {
    **{k: ("median", "p90") for k in ("motion_head", "motion_body", "motion_ratio")},
    **{k: ("median", "p10", "p90") for k in ("blob_area", "blob_height", "blob_width", "blob_aspect", "blob_dy")},
    **{k: ("median", "p10", "p90") for k in ("neck_rel_y", "nose_rel_y", "still_sec", "wall_sec", "nose_floor")},
    "length_local": ("median", "p10", "std"),
}
#: Signals whose later half is compared with the earlier one.
TREND = (
    "length_local", "blob_height", "blob_width", "blob_aspect", "blob_area", "blob_dy", "neck_rel_y", "nose_rel_y", "full_length",
    "body_length", "conf_nose", "motion_body", "body_speed", "wall_distance", "nose_floor",
)


def spec_with_trend(spec: dict[str, tuple[str, ...]], trend: Sequence[str] = TREND) -> dict[str, tuple[str, ...]]:
    return {k: (*v, "trend") if k in trend else v for k, v in spec.items()}


def spec_of(columns: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The statistics of the signals that a table has."""
    return spec_with_trend({k: v for k, v in (SPEC | EXTRA_SPEC).items() if k in columns})


def with_rules(triaged: DataFrame) -> DataFrame:
    """Adds the rules' flags as signals."""
    return triaged.withColumns({f"rule_{k}": F.col(k).cast("double") for k in C.RULES})


def statistic(name: str, value: str, late: Column | None = None) -> Column:
    """An aggregate by name; trend needs the rows of the window's later half."""
    if name == "trend":
        return F.avg(F.when(late, F.col(value))) - F.avg(F.when(~late, F.col(value)))
    shares = {"median": 0.5, "p10": 0.1, "p90": 0.9}
    if name in shares:
        return F.percentile(value, F.lit(shares[name]))
    return {"mean": F.avg, "std": F.stddev_pop}[name](value)


def describe_window(df: DataFrame, group: Sequence[str], spec: dict[str, tuple[str, ...]], late: Column | None = None) -> DataFrame:
    """A row per group with the statistics of spec over what is not null."""
    return df.groupBy(*group).agg(*(statistic(s, v, late).alias(f"{v}_{s}") for v, stats in spec.items() for s in stats))


#: Rows that are worked off together, beside the rows around them that their windows reach into.
BLOCK = 16384


def _quantile(ordered: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    """Interpolated quantile of each line of ordered; missing values come last."""
    most = np.maximum(counts - 1, 0)
    at = share * most
    low, first = at.astype(np.int64), np.arange(len(ordered)) * ordered.shape[1]
    flat = ordered.ravel()
    a, b = flat[first + low], flat[first + np.minimum(low + 1, most)]
    with np.errstate(invalid="ignore"):
        return np.where(at > low, a + (b - a) * (at - low), a)


class _Line:
    """The values of a signal in a line, whose windows are described. Sums are taken
    window by window, for running sums would lose digits; only counts are running."""

    def __init__(self, values: np.ndarray):
        known = ~np.isnan(values)
        self.values, self.filled = values, np.where(known, values, 0.0)
        self.known, self.counted = known, np.concatenate([[0], np.cumsum(known)])

    def windows(self, values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(values, size)[starts]

    def counts(self, starts: np.ndarray, size: int) -> np.ndarray:
        return self.counted[starts + size] - self.counted[starts]

    def mean(self, starts: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.windows(self.filled, starts, size).sum(axis=1) / self.counts(starts, size)

    def describe(self, starts: np.ndarray, size: int, stats: Sequence[str]) -> dict[str, np.ndarray]:
        """Statistics of the windows of size values from starts on, over what is not
        missing; NaN where nothing is left. trend: later half minus earlier one."""
        shares, out = {"median": 0.5, "p10": 0.1, "p90": 0.9}, {}
        if any(s in shares for s in stats):
            ordered, counts = self.windows(self.values, starts, size), self.counts(starts, size)
            ordered.sort(axis=1)
        for s in stats:
            if s in shares:
                out[s] = _quantile(ordered, counts, shares[s])
            elif s == "mean":
                out[s] = self.mean(starts, size)
            elif s == "std":
                away = self.windows(self.filled, starts, size) - self.mean(starts, size)[:, None]
                squares = np.where(self.windows(self.known, starts, size), away * away, 0.0).sum(axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[s] = np.sqrt(squares / self.counts(starts, size))
            else:
                late = size // 2
                out[s] = self.mean(starts + late, size - late) - self.mean(starts, late)
        return out


def _stretches(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int) -> Iterator[list[tuple[pa.RecordBatch, np.ndarray, bool]]]:
    """Lists of stretches, rows rows together: of each its session's keys as one row,
    its signals' values and whether a session begins with it. Batches: keys, _row, signals."""
    for batch in batches:
        names, begins = batch.select(list(keys)), batch.column(len(keys)).to_numpy() == 1
        values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keys) + 1 :]])
        for low in range(0, batch.num_rows, rows):
            high = min(low + rows, batch.num_rows)
            ends = [low, *(low + 1 + np.flatnonzero(begins[low + 1 : high])).tolist(), high]
            yield [(names.slice(i, 1), values[:, i:j], bool(begins[i])) for i, j in zip(ends, ends[1:], strict=False)]


def _windows(
    signals: DataFrame, spec: dict[str, tuple[str, ...]], shapes: Sequence[tuple[str, int, int]], step: int, keys: Sequence[str], place: str, full: bool
) -> DataFrame:
    """A row (keys, place, statistics, _rows) per window. shapes: name, rows before
    the place, rows in all; places are 0, step, ...; full: only windows that lie in
    the session (or the first). _rows: those of the session up to the window's end.

    Tasks read their sessions in order, some thousand rows at a time, short
    sessions together; of a session that goes on, the rows that later windows
    reach into are kept. So what a task holds is bounded whatever a session's length.
    """
    before, after = max(b for _, b, _ in shapes), max(n - b for _, b, n in shapes)
    gap, block, columns = max(before, after), BLOCK, [f"{name}{v}_{s}" for name, _, _ in shapes for v, stats in spec.items() for s in stats]

    def described(parts: list[tuple]) -> pa.RecordBatch:
        """parts: keys, position of the first row at hand, values, places, rows."""
        offsets = np.cumsum([gap, *(values.shape[1] + gap for _, _, values, _, _ in parts)])
        rows = np.concatenate([np.arange(o, o + p[2].shape[1]) for o, p in zip(offsets, parts, strict=False)])
        at = np.concatenate([p[3] - p[1] + o for o, p in zip(offsets, parts, strict=False)])
        lines, found = np.full((len(spec), offsets[-1]), np.nan), {}
        lines[:, rows] = np.concatenate([p[2] for p in parts], axis=1)
        for (v, stats), values in zip(spec.items(), lines, strict=True):
            line = _Line(values)
            for name, reach, size in shapes:
                for s, values in line.describe(at - reach, size, stats).items():
                    found[f"{name}{v}_{s}"] = pa.array(values, from_pandas=True)
        each = pa.array(np.repeat(np.arange(len(parts)), [len(p[3]) for p in parts]))
        named = [pa.concat_arrays([p[0].column(k) for p in parts]).take(each) for k in keys]
        places = np.concatenate([p[3] for p in parts])
        left = np.concatenate([np.minimum(p[4], p[3] + shapes[0][2] - shapes[0][1]) for p in parts])
        return pa.RecordBatch.from_arrays([*named, pa.array(places), *(found[c] for c in columns), pa.array(left)], names=[*keys, place, *columns, "_rows"])

    def part(session: tuple, ended: bool) -> tuple:
        key, low, values, first = session
        n = low + values.shape[1]
        places = np.arange(first, n if ended else max(first, n - after + 1), step)
        if full:
            places = places[(places + shapes[0][2] <= n) | (places == 0)]
        return key, low, values, places, n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going = None  # keys, position of the first row that is kept, values, next place
        for stretches in _stretches(batches, keys, block):
            parts = []
            for key, values, begins in stretches:
                if not begins:
                    going = (key, going[1], np.concatenate([going[2], values], axis=1), going[3])
                    continue
                if going is not None:
                    parts.append(part(going, True))
                going = (key, 0, values, 0)
            parts.append(part(going, False))
            _, low, values, places, _ = parts[-1]
            following = going[3] + step * len(places)
            kept = min(max(0, following - before - low), values.shape[1])
            going = (going[0], low + kept, values[:, kept:], following)
            if any(len(p[3]) for p in parts):
                yield described(parts)
        if going is not None and len((last := part(going, True))[3]):
            yield described([last])

    schema = T.StructType(
        [*(signals.schema[k] for k in keys), T.StructField(place, T.LongType()), *(T.StructField(c, T.DoubleType()) for c in columns), T.StructField("_rows", T.LongType())]
    )
    # the window deals the rows out and orders them, where they are not so already
    rows = signals.select(*keys, F.row_number().over(over(keys)).alias("_row"), *(F.col(v).cast("double").alias(v) for v in spec))
    return rows.mapInArrow(work, schema)


def centered_features(signals: DataFrame, spec: dict[str, tuple[str, ...]], scales: Sequence[int] = C.SCALES, step: int = C.STEP, keys: Sequence[str] = KEYS) -> DataFrame:
    """Statistics of windows around the rows 0, step, 2 step...; a window of
    size rows begins size // 2 rows before its centre and is cut at the ends."""
    return _windows(signals, spec, [(f"w{size}_", size // 2, size) for size in scales], step, keys, "centre", False).drop("_rows")


def sliding_features(signals: DataFrame, spec: dict[str, tuple[str, ...]], window: int, step: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Statistics of the full windows that start at 0, step, ...; centre is the
    middle row. A session shorter than a window is one window."""
    out = _windows(signals, spec, [("", 0, window)], step, keys, "start", True)
    centre = F.when(F.col("_rows") < window, F.expr("_rows div 2").cast("double")).otherwise(F.col("start") + F.lit((window - 1) / 2))
    return out.withColumn("centre", centre).drop("_rows")


def nearest_window_score(frames: DataFrame, scores: DataFrame, step: int, keys: Sequence[str] = KEYS, first: float = 0.0, pos: str = "pos") -> DataFrame:
    """Frames with the score of the window whose centre is nearest: window
    rint((pos - first) / step), clipped. scores: keys, window from 0, score. Not
    broadcast by the size of a file of windows, which is far smaller than its rows."""
    most = scores.groupBy(*keys).agg(F.max("window").alias("_most"))
    at = F.rint((F.col(pos) - F.lit(first)) / F.lit(step)).cast("long")
    placed = frames.join(most.hint("merge"), list(keys)).withColumn("window", F.greatest(F.lit(0), F.least(at, F.col("_most"))))
    return placed.join(scores.hint("merge"), [*keys, "window"]).drop("_most", "window")


def score_context(scores: DataFrame, keys: Sequence[str] = KEYS, order: str = "window", score: str = "score") -> DataFrame:
    """Scores of the windows around each window, their maxima and means."""
    w, found = over(keys, order), {}
    for k in C.CONTEXT_OFFSETS:
        found[f"ctx_prev{k}"] = F.lag(score, k).over(w)
        found[f"ctx_next{k}"] = F.lead(score, k).over(w)
    for span in C.CONTEXT_SPANS:
        around = w.rowsBetween(-(span // 2), span // 2)
        found[f"ctx_max{span}"] = F.max(score).over(around)
        found[f"ctx_mean{span}"] = F.avg(score).over(around)
    return scores.withColumn("ctx_self", F.col(score)).withColumns(found)


def undetected_to_null(pose: DataFrame, keypoints: Sequence[str]) -> DataFrame:
    """Coordinates below zero are points that were not detected."""
    made = {}
    for k in keypoints:
        made |= {f"{k}_x": detected(f"{k}_x", f"{k}_x", f"{k}_y"), f"{k}_y": detected(f"{k}_y", f"{k}_x", f"{k}_y")}
    return pose.withColumns(made)
