"""Column expressions: names, labels, geometry."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CONFIDENCE, LABEL_PRIORITY, NOTABLE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def arena_of(session: Column | str) -> Column:
    """Arena of a session id: the recording family and the camera."""
    s = col(session)
    family = F.when(s.startswith("HD"), F.lit("HD")).otherwise(F.lit("NOR"))
    return F.concat(family, F.lit("_cam"), F.substring_index(s, "_cam", -1))


def animal_of(session: Column | str) -> Column:
    """The second token of a session id; numbers without leading zeros."""
    token = F.split(col(session), "_")[1]
    return F.coalesce(F.expr("cast(null as string)"), F.when(token.rlike("^[0-9]+$"), token.cast("long").cast("string")).otherwise(token))


def label_set(labels: Column | str, label: Column | str, also: Column | str) -> Column:
    """Set of labels of a clip from the three formats, in one array."""
    many = F.nullif(col(labels), F.lit(""))
    extra = F.when(F.nullif(col(also), F.lit("")).isNotNull(), F.split(col(also), ";")).otherwise(F.array().cast("array<string>"))
    return F.when(many.isNotNull(), F.array_distinct(F.split(many, ";"))).otherwise(F.array_union(F.array(col(label)), extra))


def primary_label(names: Column | str, priority: Sequence[str] = LABEL_PRIORITY) -> Column:
    """First label by priority; null if none is known."""
    order = F.array(*map(F.lit, priority))
    return F.get(F.filter(order, lambda p: F.array_contains(col(names), p)), F.lit(0))


def is_notable(names: Column | str, extra: Sequence[str] = ()) -> Column:
    return F.arrays_overlap(col(names), F.array(*map(F.lit, (*NOTABLE, *extra))))


def one_hot(label: Column | str, names: Sequence[str]) -> dict[str, Column]:
    """A flag per name from a number; unknown numbers give none."""
    return {n: F.coalesce(col(label) == i, F.lit(False)).alias(n) for i, n in enumerate(names)}


def band_edges(name: Column | str) -> tuple[Column, Column]:
    """Bounds of a score band from its name: band_70_80 gives 0.7 and 0.8."""
    parts = F.split(col(name), "_")
    return parts[F.size(parts) - 2].cast("double") / 100, parts[F.size(parts) - 1].cast("double") / 100


def confident(value: Column | str, p: Column | str, threshold: float = CONFIDENCE) -> Column:
    return F.when(col(p) >= threshold, col(value))


def detected(value: Column | str, x: Column | str, y: Column | str) -> Column:
    """A value where the point was detected at all, whatever its confidence."""
    return F.when((col(x) >= 0) & (col(y) >= 0), col(value))


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def head_direction() -> tuple[Column, Column]:
    """From the middle of the ears to the nose."""
    c = F.col
    return (
        c("nose_x") - (c("ear_left_x") + c("ear_right_x")) / 2,
        c("nose_y") - (c("ear_left_y") + c("ear_right_y")) / 2,
    )


def point_distances(keypoints: Sequence[str]) -> dict[str, Column]:
    """Distance of every pair of keypoints, on unmasked coordinates."""
    return {
        f"dist_{a}_{b}": length(F.col(f"{a}_x") - F.col(f"{b}_x"), F.col(f"{a}_y") - F.col(f"{b}_y"))
        for a, b in combinations(keypoints, 2)
    }


def interval_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two inclusive intervals."""
    common = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1)
    return common / (a_end - a_start + 1 + b_end - b_start + 1 - common)


def _corners(polygon: Column) -> tuple[Column, Column]:
    """The corners of a polygon as two arrays of numbers."""
    return polygon["x"].cast("array<double>"), polygon["y"].cast("array<double>")


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(float)


def _each_side(xs: pa.Array, ys: pa.Array) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """For the n-th sides of all polygons of a batch: which rows have one, and
    from where (ax, ay) to where (bx, by)."""
    n = np.nan_to_num(_numbers(pc.list_value_length(xs))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    cx, cy = _numbers(xs.flatten()), _numbers(ys.flatten())
    for i in range(n.max(initial=0)):
        rows = np.flatnonzero(n > i)
        a, b = first[rows] + i, first[rows] + (i + 1) % n[rows]
        yield rows, (cx[a], cy[a], cx[b], cy[b])


def _inside(x: pa.Array, y: pa.Array, xs: pa.Array, ys: pa.Array) -> np.ndarray:
    px, py, crossings = _numbers(x), _numbers(y), np.zeros(len(x), np.int64)
    with np.errstate(invalid="ignore", divide="ignore"):
        for rows, (ax, ay, bx, by) in _each_side(xs, ys):
            cut = (bx - ax) * (py[rows] - ay) / (by - ay) + ax
            crossings[rows] += ((ay > py[rows]) != (by > py[rows])) & (px[rows] < cut)
    return crossings % 2 == 1


def _away(x: pa.Array, y: pa.Array, xs: pa.Array, ys: pa.Array) -> np.ndarray:
    px, py, near = _numbers(x), _numbers(y), np.full(len(x), np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        for rows, (ax, ay, bx, by) in _each_side(xs, ys):
            dx, dy, ox, oy = bx - ax, by - ay, px[rows], py[rows]
            long = dx * dx + dy * dy
            t = np.where(long == 0, 0.0, ((ox - ax) * dx + (oy - ay) * dy) / np.where(long == 0, 1.0, long))
            t = np.maximum(0.0, np.minimum(1.0, t))
            sx, sy = ox - (ax + t * dx), oy - (ay + t * dy)
            near[rows] = np.minimum(near[rows], np.sqrt(sx * sx + sy * sy))
    return near


@cache
def _polygon_udfs() -> tuple[Callable, Callable]:
    """Sides of polygons by numpy, over the batches of a task: as expressions they are
    functions of arrays, or methods that are too long for the JVM to compile."""

    def inside(x: pa.Array, y: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array(_inside(x, y, xs, ys))

    def distance(x: pa.Array, y: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        near = _away(x, y, xs, ys)
        gone = ~np.isfinite(near) & (_numbers(pc.fill_null(pc.list_value_length(xs), 0)) == 0)
        missing = gone | ~np.asarray(x.is_valid()) | ~np.asarray(y.is_valid())
        return pa.array(np.where(_inside(x, y, xs, ys), near, -near), mask=missing)

    return F.arrow_udf(inside, "boolean"), F.arrow_udf(distance, "double")


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Crossing parity over the sides; a missing point is outside, and so is every
    point without a polygon."""
    return _polygon_udfs()[0](x.cast("double"), y.cast("double"), *_corners(polygon))


def floor_distance(x: Column, y: Column, polygon: Column) -> Column:
    """Distance to the border: positive inside, negative outside, null for a
    missing point or polygon."""
    return _polygon_udfs()[1](x.cast("double"), y.cast("double"), *_corners(polygon))
