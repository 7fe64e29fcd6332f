"""Two markings of the same sessions: comparison, arbitration, consensus.

Frame tables carry the lanes as booleans a and b and unscorable; interval tables
have keys, start, end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .dyadic import meeting
from .intervals import bouts, touching

KEYS = ("session_id",)
MARK = ("start_frame", "end_frame")


def frame_status(df: DataFrame, a: str = "a", b: str = "b", unscorable: str = "unscorable") -> DataFrame:
    """status: unscorable, both, only_a, only_b or null."""
    x, y = F.col(a), F.col(b)
    status = F.when(F.col(unscorable), "unscorable").when(x & y, "both").when(x, "only_a").when(y, "only_b")
    return df.withColumn("status", status)


def compare_episodes(df: DataFrame, keys: Sequence[str] = KEYS, a: str = "a", b: str = "b", unscorable: str = "unscorable") -> DataFrame:
    """(keys, lane, start, end, status): episodes of either lane outside what is
    unscorable; both if the other lane is marked somewhere in them."""
    lanes = {"a": bouts(df, F.col(a) & ~F.col(unscorable), keys), "b": bouts(df, F.col(b) & ~F.col(unscorable), keys)}
    pairs = written(meeting(lanes["a"], lanes["b"].withColumnsRenamed({"start": "_s", "end": "_e"}), keys), "lane-pairs")
    ends = {"a": pairs.select(*keys, "start", "end"), "b": pairs.select(*keys, F.col("_s").alias("start"), F.col("_e").alias("end"))}
    parts = []
    for lane, found in lanes.items():
        met = ends[lane].distinct().withColumn("_met", F.lit(True))
        status = F.when(F.col("_met"), "both").otherwise(f"only_{lane}").alias("status")
        parts.append(found.join(met, [*keys, "start", "end"], "left").select(*keys, F.lit(lane).alias("lane"), "start", "end", status))
    return parts[0].unionByName(parts[1])


def disagreements(episodes: DataFrame) -> DataFrame:
    return episodes.filter("status <> 'both'")


def decision_groups(episodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, start, end, status): episodes of both lanes that chain by overlap
    are one decision."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "lane")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.coalesce((F.col("start") > reach).cast("int"), F.lit(0))
    grouped = episodes.withColumn("_new", opened).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = grouped.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("lane").alias("_l"), F.max("lane").alias("_h"))
    status = F.when(F.col("_l") != F.col("_h"), "both").otherwise(F.concat(F.lit("only_"), F.col("_l")))
    return out.select(*keys, "start", "end", status.alias("status"))


def group_marks(groups: DataFrame, marks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, start, end, lane, marks): the original marks of each lane that meet
    a group, sorted; marks: keys, lane, start_frame, end_frame."""
    hit = meeting(groups, marks, keys, b_span=MARK)
    return hit.groupBy(*keys, "start", "end", "lane").agg(F.sort_array(F.collect_list(F.struct("start_frame", "end_frame"))).alias("marks"))


def span_key() -> Column:
    return F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))


def initial_consensus(groups: DataFrame, marks: DataFrame, prefill: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, group_key, start_frame, end_frame): of the groups in both lanes the
    marks of the lane prefill; nothing for "none"."""
    both = groups.filter("status = 'both'")
    chosen = marks.filter(F.col("lane") == prefill)
    hit = meeting(both, chosen, keys, b_span=MARK)
    return hit.select(*keys, span_key().alias("group_key"), "start_frame", "end_frame")


def apply_decisions(groups: DataFrame, marks: DataFrame, decisions: DataFrame, base: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """base with the marks of every decided group's span replaced by those of the
    chosen lane (a, b or none). decisions: keys, group_key, choice; base: keys,
    start_frame, end_frame."""
    decided = groups.withColumn("group_key", span_key()).join(decisions, [*keys, "group_key"])
    spans = decided.select(*keys, "start", "end")
    gone = meeting(spans, base.select(*keys, *MARK).distinct(), keys, b_span=MARK).select(*keys, *MARK).distinct()
    rest = base.join(gone, [*keys, *MARK], "left_anti")
    lanes = marks.withColumnRenamed("lane", "choice")
    fresh = meeting(decided, lanes, [*keys, "choice"], b_span=MARK).select(*keys, *MARK)
    return rest.unionByName(fresh.distinct())


def pending(groups: DataFrame, decisions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Groups per key and how many are undecided."""
    open_ = groups.withColumn("group_key", span_key()).join(decisions.select(*keys, "group_key", F.lit(1).alias("_d")), [*keys, "group_key"], "left")
    return open_.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("_d").isNull()).alias("pending"))


def ignore_bouts(df: DataFrame, marked: str, predicted: str, ignored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The masks without the ignored episodes and without every detection that
    touches one; ignored: keys, start, end in row positions."""
    from .intervals import intervals_to_mask, with_position

    rows = with_position(df, keys, name="_pos")
    cut = ignored.select(*keys, F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))
    gone = touching(bouts(df, predicted, keys), ignored, keys, "left_semi")
    gone = gone.select(*keys, F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))
    rows = intervals_to_mask(rows, cut, keys, "_ignored", "_pos")
    rows = intervals_to_mask(rows, gone, keys, "_gone", "_pos")
    return rows.withColumn(marked, F.col(marked) & ~F.col("_ignored")).withColumn(predicted, F.col(predicted) & ~F.col("_gone")).drop("_pos", "_ignored", "_gone")
