"""Joins of points and intervals by aligned spans.

An interval is the disjoint union of few aligned spans: at level k a span is
2 ** (BASE_BITS + FAN_BITS * k) frames long and begins at a multiple of that, and an interval of n
frames needs 6 spans a level at most. A point lies in one span of each
level. So an interval and a point that it holds meet in exactly one equal
(level, span), whatever the interval's length: an equi join, with the bounds as a
residual at the two ends. A point is looked up in the levels that occur, one in
most tables.

Two intervals meet where the later one begins in the other, so that pairs are
found by their beginnings, each once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames of a span of level 0 and spans of a level in one of the next, as powers of 2.
BASE_BITS, FAN_BITS = 10, 2


def spans(start: str, end: str) -> Column:
    """The aligned spans of start..end as an array of (level, at), whole spans of
    level 0 at the ends."""
    fan = 1 << FAN_BITS
    part = lambda low, high: f"if({low} <= {high}, transform(sequence({low}, {high}), i -> struct(l as level, i as at)), array())"
    up, down = f"shiftright(acc.lo + {fan - 1}, {FAN_BITS})", f"shiftright(acc.hi + 1, {FAN_BITS})"
    # what is not whole in the next level stays in this one, on both sides
    step = f"""if(acc.lo > acc.hi, acc, if({up} < {down},
        struct({up} as lo, {down} - 1 as hi, concat(acc.found, {part('acc.lo', f'{fan} * {up} - 1')}, {part(f'{fan} * {down}', 'acc.hi')}) as found),
        struct(1L as lo, 0L as hi, concat(acc.found, {part('acc.lo', 'acc.hi')}) as found)))"""
    first = f"""struct(shiftright(cast({start} as bigint), {BASE_BITS}) as lo, shiftright(cast({end} as bigint), {BASE_BITS}) as hi,
        cast(array() as array<struct<level:int,at:bigint>>) as found)"""
    bucket = lambda name: F.shiftright(F.col(name).cast("long"), BASE_BITS)
    # a cover of n spans of level 0 ends at the level of one span, and most have one
    last = f"cast(ceil(log(2, shiftright(cast({end} as bigint) - cast({start} as bigint), {BASE_BITS}) + 2)) / {FAN_BITS} as int) + 1"
    covered = F.expr(f"aggregate(sequence(0, {last}), {first}, (acc, l) -> {step}, acc -> acc.found)")
    one = F.array(F.struct(F.lit(0).alias("level"), bucket(start).alias("at")))
    return F.when(F.col(start) <= F.col(end), F.when(bucket(start) == bucket(end), one).otherwise(covered))


def point_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str) -> DataFrame:
    """Rows of points with the intervals of their key that hold them: the columns
    of points and those of intervals that are no keys."""
    own = {c: f"_i_{i}" for i, c in enumerate(intervals.columns)}  # both sides may come from one table
    cut = intervals.withColumn("_span", F.explode(spans(start, end)))
    cut = cut.select(*(F.col(c).alias(name) for c, name in own.items()), F.col("_span.level").alias("_level"), F.col("_span.at").alias("_at"))
    levels = intervals.select(F.explode(F.transform(spans(start, end), lambda s: s["level"])).alias("_l")).agg(F.collect_set("_l").alias("_levels"))
    probes = F.expr(f"transform(_levels, l -> struct(l as level, shiftright(cast({point} as bigint), {BASE_BITS} + {FAN_BITS} * l) as at))")
    # one row, of 28 numbers at most
    left = points.crossJoin(F.broadcast(levels)).withColumn("_p", F.explode(probes))
    left = left.select(*points.columns, F.col("_p.level").alias("_plevel"), F.col("_p.at").alias("_pat"))
    on = [F.col(k).eqNullSafe(F.col(own[k])) for k in keys] + [F.col("_plevel") == F.col("_level"), F.col("_pat") == F.col("_at")]
    # a written table of intervals is small on disk and large in memory: not to be
    # broadcast by the size of its files
    joined = left.join(cut.hint("merge"), on).filter(F.col(point).between(F.col(own[start]), F.col(own[end])))
    return joined.select(*points.columns, *(F.col(own[c]).alias(c) for c in intervals.columns if c not in keys))


def meeting(
    a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: tuple[str, str] = ("start", "end"), b_span: tuple[str, str] = ("_s", "_e"), margin: int = 0
) -> DataFrame:
    """Pairs of rows of a key whose spans meet, or come within margin: the columns
    of a and those of b that are no keys, of other names than a's."""
    columns = [*a.columns, *(c for c in b.columns if c not in keys)]
    wide = a.withColumns({"_from": F.col(a_span[0]) - margin, "_to": F.col(a_span[1]) + margin})
    later_b = point_join(b, wide, keys, b_span[0], "_from", "_to").select(columns)
    rest = b.withColumn("_after", F.col(b_span[0]) + 1)
    later_a = point_join(wide, rest, keys, "_from", "_after", b_span[1]).select(columns)
    return later_b.unionByName(later_a)
