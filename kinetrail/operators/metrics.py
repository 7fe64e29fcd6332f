"""Frame and episode metrics.

Frame tables hold one boolean column per behaviour for the truth and one for the
prediction; totals are one aggregation each. Episodes are matched on the candidate
pairs that a range join finds: in rounds of mutual best pairs, or by a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import interval_iou
from ..sources.scratch import written
from .dyadic import meeting
from .intervals import bouts

KEYS = ("session_id",)


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, and empty where b is 0."""
    share = a / F.nullif(b, F.lit(0))
    return share if empty is None else F.coalesce(share, F.lit(empty))


def unpivot(df: DataFrame, groups: dict[str, dict[str, Column]], label: str) -> DataFrame:
    """One row of aggregates to one row per group: {group: {column: aggregate}}."""
    parts = [F.struct(F.lit(g).alias(label), *(c.alias(n) for n, c in cols.items())) for g, cols in groups.items()]
    return df.agg(F.array(*parts).alias("_rows")).select(F.explode("_rows").alias("_r")).select("_r.*")


def frame_metrics(df: DataFrame, behaviors: Sequence[str], true: str = "{}", pred: str = "pred_{}", scorable: str = "scorable") -> DataFrame:
    """tp, fp, fn, tn, prevalence, precision, recall, f1 per behaviour."""
    groups = {}
    for b in behaviors:
        t, p = F.col(true.format(b)), F.col(pred.format(b))
        groups[b] = {"tp": F.count_if(t & p), "fp": F.count_if(~t & p), "fn": F.count_if(t & ~p), "tn": F.count_if(~t & ~p)}
    out = unpivot(df.filter(scorable), groups, "behavior")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumn("prevalence", ratio(tp + fn, tp + fp + fn + tn)).withColumn("precision", ratio(tp, tp + fp))
    return out.withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def cooccurrence(df: DataFrame, behaviors: Sequence[str], scorable: str = "scorable") -> DataFrame:
    """(a, b, share): share of scorable frames with both behaviours."""
    n = F.count(F.lit(1))
    groups = {f"{a}|{b}": {"share": ratio(F.count_if(F.col(a) & F.col(b)), n)} for a in behaviors for b in behaviors}
    out = unpivot(df.filter(scorable), groups, "_pair")
    return out.select(F.split("_pair", r"\|")[0].alias("a"), F.split("_pair", r"\|")[1].alias("b"), "share")


def _count_true(behaviors: Sequence[str]) -> Column:
    return sum((F.col(b).cast("int") for b in behaviors), F.lit(0))


def multilabel_rate(df: DataFrame, behaviors: Sequence[str], scorable: str = "scorable") -> DataFrame:
    many = (_count_true(behaviors) > 1).cast("double")
    return df.filter(scorable).agg(F.coalesce(F.avg(many), F.lit(0.0)).alias("multilabel_rate"))


def unreachable_recall(df: DataFrame, behaviors: Sequence[str], scorable: str = "scorable") -> DataFrame:
    """Frames of a behaviour that it shares with another one."""
    groups = {b: {"frames": F.count_if(b), "frames_shared": F.count_if(F.col(b) & (_count_true(behaviors) > 1))} for b in behaviors}
    out = unpivot(df.filter(scorable), groups, "behavior")
    return out.withColumn("unreachable_pct", ratio(F.col("frames_shared") * 100.0, F.col("frames")))


def _numbered(df: DataFrame, keys: Sequence[str], start: str, name: str) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(start)) - 1).cast("int"))


def overlapping_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, parts: Sequence[str] = ()) -> DataFrame:
    """(keys, parts, a_index, a_start, a_end, b_...): pairs that meet. parts: columns
    that split the rows of a further, of which each part meets all of b."""
    left = _numbered(a, [*keys, *parts], start, "a_index").select(*keys, *parts, "a_index", F.col(start).alias("a_start"), F.col(end).alias("a_end"))
    right = _numbered(b, keys, start, "b_index").select(*keys, "b_index", F.col(start).alias("b_start"), F.col(end).alias("b_end"))
    return meeting(left, right, keys, ("a_start", "a_end"), ("b_start", "b_end"))


def _grouped(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds _g: pairs whose spans chain in time. Pairs that share a bout are in
    one group, so that a choice in one leaves the others alone."""
    w = Window.partitionBy(*keys).orderBy("_lo")
    spans = pairs.withColumn("_lo", F.least("a_start", "b_start")).withColumn("_hi", F.greatest("a_end", "b_end"))
    chained = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("_lo")
    fresh = spans.withColumn("_g", F.when(chained, 0).otherwise(1))
    return fresh.withColumn("_g", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_lo", "_hi")


#: Rounds of mutual best pairs after which what is left is matched chain by chain.
ROUNDS = 12


def _mutual(pairs: DataFrame, keys: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """pairs with _taken (the best pair of both its bouts) and _over (one of its
    bouts is taken)."""
    own = F.struct(*rank)
    a, b = Window.partitionBy(*keys, "a_index"), Window.partitionBy(*keys, "b_index")
    best = pairs.withColumn("_a", F.max(own).over(a)).withColumn("_b", F.max(own).over(b))
    best = best.withColumn("_taken", (F.col("_a") == own) & (F.col("_b") == own)).drop("_a", "_b")
    used = best.withColumn("_over", F.bool_or("_taken").over(b))
    return used.withColumn("_over", F.col("_over") | F.bool_or("_taken").over(a))


def _greedy(rank: Sequence[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The best pair first, then the best of those that touch none taken, in a
    chain of pairs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(rank), ascending=False)
        seen_a, seen_b, keep = set(), set(), []
        for a, b in zip(rows["a_index"].tolist(), rows["b_index"].tolist(), strict=True):
            keep.append(a not in seen_a and b not in seen_b)
            if keep[-1]:
                seen_a.add(a)
                seen_b.add(b)
        return rows[keep].drop(columns="_g")

    return run


def one_to_one(pairs: DataFrame, keys: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """The pairs that a walk by falling rank takes, if it leaves out every pair with
    a bout that is taken. pairs: overlapping_pairs() with the columns of rank.

    A pair that is the best one of both its bouts is taken whatever else happens.
    So rounds take all such pairs at once and drop those that share a bout with
    them, which ends where the walk does. Long chains of ever lower ranks would
    need a round a pair: what ROUNDS leave is walked, chain by chain.
    """
    keys, open_, found = list(keys), pairs, None
    for left in range(ROUNDS, -1, -1):
        if left:
            judged = written(_mutual(open_, keys, rank), "pairs")
            taken, open_ = judged.filter("_taken").select(pairs.columns), judged.filter("not _over").select(pairs.columns)
        else:
            taken = _grouped(open_, keys).select(*pairs.columns, "_g").groupBy(*keys, "_g").applyInPandas(_greedy(rank), pairs.schema)
        found = taken if found is None else found.unionByName(taken)
        if not left or open_.isEmpty():
            break
    return found


def match_bouts(true: DataFrame, pred: DataFrame, keys: Sequence[str], threshold: float = 0.5, start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """(keys, true_index, pred_index, iou): greedy matching by falling (iou,
    true index, pred index) from threshold on. Bouts that do not overlap within a
    side need one round of one_to_one() from a threshold of 0.5 on."""
    pairs = overlapping_pairs(true, pred, keys, start, end).withColumn(
        "iou", interval_iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    ).filter(F.col("iou") >= threshold)
    found = one_to_one(pairs, keys, ["iou", "a_index", "b_index"]).select(*keys, "a_index", "b_index", "iou")
    return found.withColumnsRenamed({"a_index": "true_index", "b_index": "pred_index"})


def bout_metrics(true: DataFrame, pred: DataFrame, group: Sequence[str] = ("behavior",), keys: Sequence[str] = ("session_id", "behavior"), threshold: float = 0.5) -> DataFrame:
    """Per group: episodes, matches, recall, precision, count and time errors."""
    frames = F.sum(F.col("end_frame") - F.col("start_frame") + 1)
    t = true.groupBy(*group).agg(F.count(F.lit(1)).alias("n_true"), frames.alias("time_true"))
    p = pred.groupBy(*group).agg(F.count(F.lit(1)).alias("n_pred"), frames.alias("time_pred"))
    m = match_bouts(true, pred, keys, threshold).groupBy(*group).agg(F.count(F.lit(1)).alias("matched"))
    out = t.join(p, list(group), "full").join(m, list(group), "left").na.fill(0, ["n_true", "n_pred", "matched", "time_true", "time_pred"])
    return out.withColumns(
        {
            "bout_recall": ratio(F.col("matched"), F.col("n_true")),
            "bout_precision": ratio(F.col("matched"), F.col("n_pred")),
            "count_error": F.col("n_pred") - F.col("n_true"),
            "time_error_pct": ratio((F.col("time_pred") - F.col("time_true")) * 100.0, F.col("time_true"), None),
        }
    )


def episode_hits(marked: DataFrame, found: DataFrame, keys: Sequence[str] = KEYS, parts: Sequence[str] = ()) -> DataFrame:
    """(keys, parts, matched, hits, real): marks that meet a detection (hits), detections
    that meet a mark (real), and pairs where every detection, in order, takes the
    first unused mark that it meets. Both with start, end in rows, without overlaps
    within a side; keys without a meeting have no row. parts: columns of found, each
    part by itself against all marks, which are not repeated.

    Detections in order meet stretches of marks of which two neighbours share one
    mark at most, the last of the one and the first of the other. Whether that one
    is used is all that a detection has to know: with one mark it is used
    afterwards, with three or more the last is free, and with two, of which the
    first is shared, it stays as it was. So it is the last value that was settled.
    """
    pairs = overlapping_pairs(found, marked, keys, "start", "end", parts)
    keys = [*keys, *parts]
    met = pairs.groupBy(*keys, "a_index").agg(F.min("b_index").alias("_lo"), F.max("b_index").alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("a_index")
    n = F.col("_hi") - F.col("_lo") + 1
    shared = F.coalesce(F.lag("_hi").over(w) == F.col("_lo"), F.lit(False))
    settled = F.when(F.col("_shared") & (n == 2), F.lit(None)).otherwise(n == 1)
    walk = met.withColumn("_shared", shared).withColumn("_settled", settled)
    used = F.coalesce(F.last("_settled", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    walk = walk.withColumn("_missed", (n == 1) & F.col("_shared") & used)
    return walk.groupBy(*keys).agg(
        F.count_if(~F.col("_missed")).alias("matched"),
        (F.sum(n) - F.count_if("_shared")).cast("long").alias("hits"), F.count(F.lit(1)).alias("real"),
    )


def matched_episodes(marked: DataFrame, found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, matched) as in episode_hits(), also for episodes that overlap within
    a side."""
    pairs = overlapping_pairs(found, marked, keys, "start", "end").withColumns({"_first": -F.col("a_index"), "_second": -F.col("b_index")})
    return one_to_one(pairs, keys, ["_first", "_second"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"))


def threshold_counts(marked: DataFrame, found: DataFrame, grid: Sequence[float], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, threshold, manual, found, pairs, hits, real) of every key that has
    episodes: numbers of episodes and of episode_hits() at every threshold.

    marked: keys, start, end; found: threshold_bouts() on the same grid.
    """
    own, last = [*keys, "level"], len(grid) - 1
    n = lambda d, by, name: d.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    manual = n(marked, keys, "manual").withColumn("level", F.explode(F.expr(f"sequence(0, {last})")))
    # a row per key and level: more than the sizes that are known before tell
    out = manual.hint("merge").join(n(found, own, "found").hint("merge"), own, "full")
    out = out.join(episode_hits(marked, found, keys, ["level"]).hint("merge"), own, "left")
    out = out.withColumnRenamed("matched", "pairs").na.fill(0, ["manual", "found", "pairs", "hits", "real"])
    threshold = F.get(F.array(*(F.lit(float(g)) for g in grid)), F.col("level"))
    return out.withColumn("threshold", threshold).drop("level")


def compare(df: DataFrame, marked: str, predicted: str, fps: float = 30.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Agreement of two masks per key, by frames and by episodes."""
    m, p = F.col(marked), F.col(predicted)
    frames = df.groupBy(*keys).agg(
        F.count_if(m).alias("_m"), F.count_if(p).alias("_p"), F.count_if(m & p).alias("_b")
    )
    manual, found = bouts(df, marked, keys), bouts(df, predicted, keys)
    n = lambda d, c: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(c))
    out = frames.join(n(manual, "manual_bouts"), list(keys), "left").join(n(found, "detected_bouts"), list(keys), "left")
    met = episode_hits(manual, found, keys).withColumnsRenamed({"hits": "_hit", "real": "_real", "matched": "matched_bouts"})
    out = out.join(met, list(keys), "left")
    out = out.na.fill(0, ["manual_bouts", "detected_bouts", "_hit", "_real", "matched_bouts"])
    return out.select(
        *keys,
        (F.col("_m") / F.lit(fps)).alias("manual_s"),
        (F.col("_p") / F.lit(fps)).alias("detected_s"),
        "manual_bouts",
        "detected_bouts",
        ratio(F.col("_b"), F.col("_m"), None).alias("frames_found"),
        ratio(F.col("_b"), F.col("_p"), None).alias("frames_right"),
        ratio(F.col("_hit"), F.col("manual_bouts"), None).alias("bouts_found"),
        ratio(F.col("_real"), F.col("detected_bouts"), None).alias("bouts_right"),
        "matched_bouts",
    )


def coverage(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Recorded rows, span of frame numbers, their ratio and the largest gap."""
    w = Window.partitionBy(*keys).orderBy("frame")
    gaps = df.withColumn("_gap", F.col("frame") - F.lag("frame").over(w))
    out = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("recorded"),
        (F.max("frame") - F.min("frame") + 1).alias("span"),
        F.coalesce(F.max("_gap"), F.lit(0)).alias("largest_gap"),
    )
    return out.withColumn("ratio", ratio(F.col("recorded"), F.col("span")))


def per_keypoint(pose: DataFrame, keypoints: Sequence[str], aggregates: dict[str, str]) -> DataFrame:
    """A row per keypoint; aggregates are SQL over {p}, its confidence column."""
    groups = {k: {n: F.expr(e.format(p=f"{k}_p")) for n, e in aggregates.items()} for k in keypoints}
    return unpivot(pose, groups, "keypoint")


#: Values up to this number are sorted in one task.
ONE_TASK = 1_000_000


def global_percentiles(df: DataFrame, values: dict[str, Column], shares: Sequence[float], accuracy: int = 100_000) -> dict[str, list[float | None]]:
    """Exact percentiles of each value over all rows; nulls take no part, without
    values null.

    Beyond ONE_TASK values: a sketch gives an interval around every percentile,
    the rows below and in it are counted, and only what lies in the interval,
    some 4 / accuracy of the rows, meets in one task.
    """
    df = df.select(*(c.cast("double").alias(n) for n, c in values.items()))
    n = df.agg(*(F.count(name).alias(name) for name in values)).first().asDict()
    if max(n.values()) <= ONE_TASK:
        found = df.agg(*(F.percentile(name, F.array(*map(F.lit, shares))).alias(name) for name in values)).first()
        return {name: list(found[name]) if found[name] is not None else [None] * len(shares) for name in values}
    width = 2.0 / accuracy
    while True:
        ends = {s: [min(1.0, max(0.0, s + d)) for d in (-width, width)] for s in shares}
        wide = sorted({e for pair in ends.values() for e in pair})
        sketch = df.agg(*(F.percentile_approx(name, wide, accuracy).alias(name) for name in values)).first()
        spans = {(name, s): [sketch[name][wide.index(e)] for e in ends[s]] for name in values if n[name] for s in shares}
        inside = {(name, s): F.col(name).between(*map(F.lit, span)) for (name, s), span in spans.items()}
        facts = df.agg(
            *(F.count_if(F.col(name) < low).alias(f"{name}|{s}|below") for (name, s), (low, _) in spans.items()),
            *(F.count_if(inside[name, s]).alias(f"{name}|{s}|in") for name, s in spans),
        ).first()
        places = {(name, s): (s * (n[name] - 1) - facts[f"{name}|{s}|below"], facts[f"{name}|{s}|in"]) for name, s in spans}
        # the sketch's ranks are near, not sure: an interval that misses its percentile is widened
        if width >= 1.0 or all(-1e-6 <= at <= m - 1 + 1e-6 for at, m in places.values()):
            break
        width *= 8
    wanted = []
    for (name, s), (at, m) in places.items():
        share = min(1.0, max(0.0, at / (m - 1))) if m > 1 else 0.0
        wanted.append(F.percentile(F.when(inside[name, s], F.col(name)), F.lit(share)).alias(f"{name}|{s}"))
    found = df.agg(*wanted).first()
    return {name: [found[f"{name}|{s}"] if n[name] else None for s in shares] for name in values}


def keypoint_coverage(pose: DataFrame, keypoints: Sequence[str], threshold: float = 0.25) -> DataFrame:
    middle = global_percentiles(pose, {k: F.col(f"{k}_p") for k in keypoints}, [0.5])
    medians = F.create_map(*(x for k in keypoints for x in (F.lit(k), F.lit(middle[k][0]).cast("double"))))
    counts = per_keypoint(pose, keypoints, {"coverage": f"avg(cast({{p}} >= {threshold} as double))", "frames_lost": f"count_if({{p}} < {threshold})"})
    return counts.select("keypoint", "coverage", medians[F.col("keypoint")].alias("median_p"), "frames_lost")


def confidence_percentiles(pose: DataFrame, keypoints: Sequence[str], shares: Sequence[int] = (5, 10, 25, 50, 75, 95)) -> DataFrame:
    found = global_percentiles(pose, {k: F.col(f"{k}_p") for k in keypoints}, [s / 100 for s in shares])
    rows = [(k, *(None if v is None else float(v) for v in found[k])) for k in keypoints]
    out = pose.sparkSession.createDataFrame(rows, "keypoint string, " + ", ".join(f"p{s} double" for s in shares))
    return out.select("keypoint", *(F.round(f"p{s}", 3).alias(f"p{s}") for s in shares))


def speed_percentiles(df: DataFrame, speed: str = "speed_body", shares: Sequence[int] = (10, 25, 50, 75, 90, 95)) -> DataFrame:
    found = global_percentiles(df, {"speed": F.col(speed)}, [s / 100 for s in shares])["speed"]
    out = df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"p{s} double" for s in shares))
    return out.select(*(F.round(f"p{s}", 1).alias(f"p{s}") for s in shares))


def composition(triaged: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of rows of each class per key and the share not to review."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return triaged.groupBy(*keys).agg(*(share(c).alias(c) for c in columns), (1 - share("review")).alias("reduction"))


def reduction_rate(triaged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return triaged.groupBy(*keys).agg((1 - F.avg(F.col("review").cast("double"))).alias("reduction"))


def object_bouts(df: DataFrame, marked: str, objects: DataFrame, margin: float = 15.0, keys: Sequence[str] = ("session_id", "field")) -> DataFrame:
    """Marked episodes in which the nose comes closer than margin to an object;
    coordinates below zero are no nose."""
    listed = objects.groupBy("session_id").agg(F.collect_list(F.struct("center_x", "center_y", "radius")).alias("_o"))
    x, y = F.col("nose_x"), F.col("nose_y")
    edge = F.array_min(F.transform("_o", lambda o: F.sqrt((x - o.center_x) * (x - o.center_x) + (y - o.center_y) * (y - o.center_y)) - o.radius))
    near = F.coalesce((x >= 0) & (y >= 0) & (edge < margin), F.lit(False))
    # found along with the episodes: no row is looked up by its place
    found = bouts(df.join(listed, "session_id", "left"), marked, keys, most={"_near": near})
    return found.filter("_near").drop("_near")
