"""Clips: presence, escape, surfacing scores, bands and curves."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import md5_numbers
from ..functions.scalars import is_notable, label_set
from .intervals import range_join
from .metrics import global_percentiles, ratio

#: Clips whose draws are a task.
DRAWING = 4096


def combine_rounds(key: DataFrame, labels: DataFrame, ambiguous_rounds: Sequence[str] = ("r1",), drop_ambiguous: bool = True) -> DataFrame:
    """Keys with the label sets of their clips; clips that are only unscorable
    go, and with drop_ambiguous those with "other" in the named rounds."""
    names = labels.select("clip_id", label_set("labels", "label", "also").alias("names"))
    out = key.join(names, "clip_id").filter(F.col("names") != F.array(F.lit("unscorable")))
    if drop_ambiguous:
        out = out.filter(~(F.col("round").isin(*ambiguous_rounds) & F.array_contains("names", "other")))
    return out


def clip_presence(frames: DataFrame, clips: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Share of a clip's frames with each flag, 0 for clips without frames, and
    any_ flags."""
    inside = range_join(frames.select(*keys, "frame", *columns), clips.select("clip_id", *keys, "start_frame", "end_frame"), keys)
    share = inside.groupBy("clip_id").agg(
        *(F.avg(F.col(c).cast("double")).alias(c) for c in columns), *(F.bool_or(c).alias(f"any_{c}") for c in columns)
    )
    out = clips.select("clip_id").join(share, "clip_id", "left")
    return out.na.fill(0.0, list(columns)).na.fill(False, [f"any_{c}" for c in columns])


def clip_evaluation(clips: DataFrame, presence: DataFrame, least: float = 0.1, extra: Sequence[str] = ()) -> DataFrame:
    """clip_id, stratum, notable, surfaced, exploration, object_detected, names."""
    df = clips.filter(F.col("names") != F.array(F.lit("unscorable"))).join(presence, "clip_id")
    return df.select(
        "clip_id", F.col("triage_label").alias("stratum"), "names", is_notable("names", extra).alias("notable"),
        ((F.col("review") >= least) | (F.col("unscorable") >= least)).alias("surfaced"),
        F.array_contains("names", "object_interaction").alias("exploration"),
        (F.col("object_interaction") >= least).alias("object_detected"),
    )


def escape_by(evaluated: DataFrame, by: str) -> DataFrame:
    """Notable clips and surfaced share per stratum, or per kind with by=names."""
    rows = evaluated.filter("notable")
    rows = rows.withColumn("kind", F.explode("names")) if by == "names" else rows.withColumn("kind", F.col(by))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("clips"), F.avg(F.col("surfaced").cast("double")).alias("surfaced_share"))


def stratum_weights(triaged: DataFrame, strata: Sequence[str], session: str = "session_id") -> DataFrame:
    """(stratum, weight): mean over sessions of the share of frames, scaled to 1."""
    per = triaged.groupBy(session).agg(*(F.avg(F.col(s).cast("double")).alias(s) for s in strata))
    means = per.agg(F.array(*(F.struct(F.lit(s).alias("stratum"), F.avg(s).alias("share")) for s in strata)).alias("_r"))
    rows = means.select(F.explode("_r").alias("_r")).select("_r.*")
    return rows.select("stratum", ratio(F.col("share"), F.sum("share").over(Window.partitionBy())).alias("weight"))


def weighted_escape(evaluated: DataFrame, weights: DataFrame, stratum: str = "stratum", target: str = "notable") -> DataFrame:
    """Weighted share of the target that is not surfaced; null without target."""
    per = evaluated.groupBy(stratum).agg(
        F.avg(F.col(target).cast("double")).alias("_t"), F.avg((F.col(target) & ~F.col("surfaced")).cast("double")).alias("_e")
    )
    joined = per.join(weights, stratum)
    return joined.agg(ratio(F.sum(F.col("weight") * F.col("_e")), F.sum(F.col("weight") * F.col("_t")), None).alias("weighted_escape"))


def weighted_rates(clips: DataFrame, truth: str, predicted: str, stratum: str, share: str) -> DataFrame:
    """Weighted recall and precision; share is the stratum's part of the video."""
    t, p = F.col(truth), F.col(predicted)
    per = clips.groupBy(stratum).agg(
        (F.min(share) / F.count(F.lit(1))).alias("_w"), F.count_if(t & p).alias("_tp"), F.count_if(~t & p).alias("_fp"), F.count_if(t).alias("_pos")
    )
    tp = F.sum(F.col("_w") * F.col("_tp"))
    return per.agg(
        ratio(tp, F.sum(F.col("_w") * F.col("_pos")), None).alias("recall"),
        ratio(tp, tp + F.sum(F.col("_w") * F.col("_fp")), None).alias("precision"),
    )


def escape_summary(clips: DataFrame, kinds: Sequence[str], test_round: str) -> DataFrame:
    """Escape over all and over the test round, and the seen share per kind."""
    missed, seen = (~F.col("surfaced")).cast("double"), F.col("surfaced").cast("double")
    return clips.agg(
        F.avg(F.when(F.col("notable"), missed)).alias("escape_all"),
        F.avg(F.when(F.col("notable") & (F.col("round") == test_round), missed)).alias("escape_test"),
        *(F.avg(F.when(F.array_contains("names", k), seen)).alias(f"seen_{k}") for k in kinds),
    )


def _drawn(stratum: str, reps: int, seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per batch of clips, stratum and repetition: how many draws hit a notable and
    how many a missed one."""
    ends = [f"{rep}|{seed}".encode() for rep in range(1, reps + 1)]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, own in frame.groupby(stratum, sort=False):
                n, notable, missed = (np.uint64(own[c].iloc[0]) for c in ("_n", "_notable", "_missed"))
                hit, lost = np.zeros(reps, "int64"), np.zeros(reps, "int64")
                for _, at, drawn in md5_numbers([clip.encode() for clip in own["_clip"]], ends):
                    place = drawn - drawn // n * n
                    hit[at] += (place < notable).sum(axis=0)
                    lost[at] += (place < missed).sum(axis=0)
                yield pd.DataFrame({stratum: name, "_rep": np.arange(1, reps + 1), "_n": int(n), "_hit": hit, "_lost": lost})

    return count


def bootstrap_escape(evaluated: DataFrame, weights: DataFrame, reps: int = 2000, seed: int = 0, stratum: str = "stratum") -> DataFrame:
    """5th and 95th percentile of the weighted escape over stratified resamples.

    Of a resample only the numbers of missed and of notable clips per stratum
    count. So a draw is a place in the stratum's order missed, notable, others,
    by an md5 hash of (clip, repetition, seed), and two bounds tell what it hit:
    no drawn clip is looked up. Every clip draws reps times; the clips are dealt out
    to tasks evenly, which hash their draws together and count them. evaluated is
    read three times: hand in a table.
    """
    notable, missed = F.col("notable"), F.col("notable") & ~F.col("surfaced")
    sizes = evaluated.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"), F.count_if(notable).alias("_notable"), F.count_if(missed).alias("_missed"))
    # few clips are much work: the size of their table says nothing of it
    dealt = evaluated.select(stratum, F.coalesce(F.concat("clip_id", F.lit("|")), F.lit("")).alias("_clip")).repartition(max(1, -(-evaluated.count() // DRAWING)))
    kind = evaluated.schema[stratum].dataType.simpleString()
    drawn = dealt.join(F.broadcast(sizes), stratum).mapInPandas(_drawn(stratum, reps, seed), f"`{stratum}` {kind}, _rep int, _n long, _hit long, _lost long")
    per = drawn.groupBy("_rep", stratum).agg((F.sum("_hit") / F.max("_n")).alias("_t"), (F.sum("_lost") / F.max("_n")).alias("_e"))
    each = per.join(weights, stratum).groupBy("_rep").agg(ratio(F.sum(F.col("weight") * F.col("_e")), F.sum(F.col("weight") * F.col("_t")), None).alias("_v"))
    return each.agg(F.percentile("_v", F.lit(0.05)).alias("p5"), F.percentile("_v", F.lit(0.95)).alias("p95"))


def surfacing_score(frames: DataFrame, clips: DataFrame, least: float = 0.1, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """(clip_id, score): the highest threshold at which a clip is still shown:
    its k-th largest valid score, +inf where poses are missing, -inf where too
    few scores are valid. frames: keys, frame, score, missing."""
    inside = range_join(frames.select(*keys, "frame", "score", "missing"), clips.select("clip_id", *keys, "start_frame", "end_frame"), keys)
    per = inside.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.col("missing").cast("double")).alias("_gone"),
        F.sort_array(F.collect_list(F.when(~F.col("missing"), F.col("score"))), asc=False).alias("_s"),
    )
    k = F.ceil(F.lit(least) * F.col("_n") - 1e-9).cast("int")
    value = F.coalesce(F.get("_s", F.greatest(k, F.lit(1)) - 1), F.lit(float("-inf")))
    return per.select("clip_id", F.when(F.col("_gone") >= least, F.lit(float("inf"))).otherwise(value).alias("score"))


def reduction_curve(frames: DataFrame, grid: Sequence[float], session: str = "session_id") -> DataFrame:
    """(threshold, skipped): mean over sessions of the share of frames under a
    threshold. Scores are bucketed by the grid and summed from above, in place
    of comparing every score with every threshold."""
    steps = F.array(*(F.lit(float(g)) for g in sorted(grid)))
    # the number of thresholds that a valid score reaches
    reached = F.when(F.col("missing"), F.lit(0)).otherwise(F.size(F.filter(steps, lambda g: F.col("score") >= g)))
    counts = frames.withColumn("_k", reached).groupBy(session, "_k").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(session)))
    spread = total.select(session, "_n", "_all", F.explode(F.expr(f"sequence(1, {len(grid)})")).alias("_t"), "_k")
    per = spread.groupBy(session, "_t").agg((1 - F.sum(F.when(F.col("_k") >= F.col("_t"), F.col("_n")).otherwise(F.lit(0))) / F.max("_all")).alias("_skip"))
    return per.groupBy("_t").agg(F.avg("_skip").alias("skipped")).select(F.element_at(steps, F.col("_t")).alias("threshold"), "skipped")


def score_bands(frames: DataFrame, tiles: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Tiles with the band of their score (cuts are quantiles of all frame
    scores, missing poses above all) and the band's share of tiles."""
    value = F.when(F.col("missing"), F.lit(float("inf"))).otherwise(F.col("score"))
    edges = F.array(*(F.lit(c).cast("double") for c in global_percentiles(frames, {"v": value}, cuts)["v"]))
    banded = tiles.withColumn("band", F.size(F.filter(edges, lambda c: c <= F.col("score"))))
    share = F.count(F.lit(1)).over(Window.partitionBy("band")) / F.count(F.lit(1)).over(Window.partitionBy())
    return banded.withColumn("band_share", share)


def exploration_agreement(frames: DataFrame, objects: DataFrame, marked: str, measured: str, fps: float = 30.0, session: str = "session_id") -> DataFrame:
    """Marked and measured exploration per session; the object is the nearest to
    the nose, the first of equals."""
    listed = objects.groupBy(session).agg(F.sort_array(F.collect_list(F.struct("object_id", "center_x", "center_y", "radius"))).alias("_o"))
    x, y = F.col("nose_x"), F.col("nose_y")
    away = F.transform("_o", lambda o: F.struct((F.sqrt((x - o.center_x) * (x - o.center_x) + (y - o.center_y) * (y - o.center_y)) - o.radius).alias("d"), o.object_id.alias("id")))
    near = frames.join(listed, session).withColumn("_near", F.array_min(away)["id"])
    m, p = F.col(marked), F.col(measured)
    out = near.groupBy(session).agg(
        F.count_if(m).alias("_m"), F.count_if(p).alias("_p"), F.count_if(m & p).alias("_b"), F.count_if(m & (F.col("_near") == 2)).alias("_m2"), F.count_if(p & (F.col("_near") == 2)).alias("_p2")
    )
    return out.select(
        session, (F.col("_m") / F.lit(fps)).alias("manual_s"), (F.col("_p") / F.lit(fps)).alias("automatic_s"),
        ratio(F.col("_b"), F.col("_m"), None).alias("found"), ratio(F.col("_b"), F.col("_p"), None).alias("right"),
        ratio(F.col("_m2"), F.col("_m"), None).alias("manual_object2"), ratio(F.col("_p2"), F.col("_p"), None).alias("automatic_object2"),
    )


def result_summary(results: DataFrame, method: Column | str = "method") -> DataFrame:
    """Pooled recall, precision, F1 and count bias per method; results has
    manual_bouts, detected_bouts, bouts_found, bouts_right, matched_bouts."""
    hits = F.sum(F.coalesce("bouts_found", F.lit(0.0)) * F.col("manual_bouts"))
    real = F.sum(F.coalesce("bouts_right", F.lit(0.0)) * F.col("detected_bouts"))
    manual, found, pairs = F.sum("manual_bouts"), F.sum("detected_bouts"), F.sum("matched_bouts")
    one = F.lit(1)
    out = results.groupBy(method).agg(
        (hits / F.greatest(one, manual)).alias("recall"), (real / F.greatest(one, found)).alias("precision"),
        (pairs / F.greatest(one, manual)).alias("one_to_one_recall"), (pairs / F.greatest(one, found)).alias("one_to_one_precision"),
        (2 * pairs / F.greatest(one, manual + found)).alias("one_to_one_f1"), (100 * (found - manual) / F.greatest(one, manual)).alias("count_bias_pct"),
    )
    return out.withColumn("f1", ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))
