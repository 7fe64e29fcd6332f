"""Agreement of paired totals. Moments are aggregated in Spark; p-values need
the t distribution and are worked out on the one row that comes out."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ratio


#: Ranges in which the sizes of differences are ranked.
RANGES = 256


def total_error(df: DataFrame, manual: str, automatic: str, session: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mse, rmse, bias, spread, bias share, relative median, worst session
    (of equals the smallest name)."""
    df = df.select(*keys, F.col(session).alias("_s"), F.col(manual).cast("double").alias("_m"), F.col(automatic).cast("double").alias("_a"))
    e = F.col("_a") - F.col("_m")
    out = df.withColumn("_e", e).withColumn("_q", e * e).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_q").alias("mse"),
        F.avg("_e").alias("bias"),
        F.var_pop("_e").alias("spread"),
        F.avg("_m").alias("manual_mean"),
        F.percentile(F.abs("_e") / F.greatest(F.col("_m"), F.lit(1.0)), F.lit(0.5)).alias("relative_median"),
        F.min(F.struct((-F.col("_q")).alias("q"), F.col("_s").alias("s"))).alias("_worst"),
        F.sum("_q").alias("_total"),
    )
    return out.select(
        *keys, "n", "mse", F.sqrt("mse").alias("rmse"), "bias", "spread",
        ratio(F.col("bias") * F.col("bias"), F.col("mse")).alias("bias_share"), "manual_mean", "relative_median",
        F.when(F.col("mse") > 0, F.col("_worst.s")).alias("worst_session"),
        F.when(F.col("mse") > 0, -F.col("_worst.q") / F.col("_total")).alias("worst_share"),
    )


def concordance(df: DataFrame, manual: str, automatic: str, keys: Sequence[str] = ()) -> DataFrame:
    """Lin's concordance correlation coefficient."""
    gap = F.avg(manual) - F.avg(automatic)
    return df.groupBy(*keys).agg((2 * F.covar_pop(manual, automatic) / (F.var_pop(manual) + F.var_pop(automatic) + gap * gap)).alias("ccc"))


def agreement_moments(df: DataFrame, manual: str, automatic: str, margin_fraction: float = 0.15, keys: Sequence[str] = ()) -> DataFrame:
    """The moments behind agreement(), limits of agreement and correlations."""
    df = df.withColumn("_d", F.col(automatic) - F.col(manual))
    gap = F.avg(manual) - F.avg(automatic)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(manual).alias("manual_mean"),
        F.avg(automatic).alias("automatic_mean"),
        F.avg("_d").alias("bias"),
        F.stddev_samp("_d").alias("sd"),
        (2 * F.covar_pop(manual, automatic) / (F.var_pop(manual) + F.var_pop(automatic) + gap * gap)).alias("ccc"),
        F.corr(manual, automatic).alias("pearson_r"),
        (100 * F.avg(F.when(F.col(manual) > 0, F.abs("_d") / F.col(manual)))).alias("mean_abs_pct_error"),
    )
    return out.withColumns(
        {
            "bias_pct": 100 * F.col("bias") / F.col("manual_mean"),
            "margin": margin_fraction * F.col("manual_mean"),
            "limit_low": F.col("bias") - 1.96 * F.col("sd"),
            "limit_high": F.col("bias") + 1.96 * F.col("sd"),
        }
    )


def signed_ranks(df: DataFrame, manual: str, automatic: str) -> DataFrame:
    """Wilcoxon's w_plus, w_minus, the number of differences that are not 0 and
    the tie term; equal sizes share their mean rank. Sizes are ranked in RANGES
    ranges, each by itself after the count of those before it."""
    d = df.select((F.col(automatic) - F.col(manual)).alias("_d")).filter("_d <> 0").withColumn("_a", F.abs("_d"))
    sizes = d.groupBy("_a").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") > 0).alias("_up"))
    found = d.agg(F.percentile_approx("_a", [i / RANGES for i in range(RANGES)], 4 * RANGES)).first()[0]
    edges = sorted(set(found or []))
    cuts = F.array(*(F.lit(e) for e in edges)) if edges else F.array().cast("array<double>")
    sizes = sizes.withColumn("_range", F.size(F.filter(cuts, lambda e: e <= F.col("_a"))))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a range
    bases = sizes.groupBy("_range").agg(F.sum("_n").alias("_n")).select("_range", earlier(Window.orderBy("_range")).alias("_base"))
    inside = earlier(Window.partitionBy("_range").orderBy("_a"))
    ranked = sizes.withColumn("_before", inside).join(bases, "_range").withColumn("_rank", F.col("_base") + F.col("_before") + (F.col("_n") + 1) / 2)
    return ranked.agg(
        F.coalesce(F.sum(F.col("_rank") * F.col("_up")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.col("_rank") * (F.col("_n") - F.col("_up"))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("nonzero"),
        F.coalesce(F.sum(F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")), F.lit(0)).alias("ties"),
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        tail = front * _beta_fraction(a, b, x) / a
    else:
        tail = 1 - front * _beta_fraction(b, a, 1 - x) / b
    tail = tail if t else 1.0
    return 1 - tail / 2 if t > 0 else tail / 2


def t_ppf(p: float, df: float) -> float:
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def _exact_signed_rank_p(w: float, n: int) -> float:
    """Two-sided p of the smaller rank sum, without ties."""
    counts = [1]
    for k in range(1, n + 1):
        longer = [0] * (len(counts) + k)
        for i, c in enumerate(counts):
            longer[i] += c
            longer[i + k] += c
        counts = longer
    return min(1.0, 2 * sum(counts[: int(w) + 1]) / 2**n)


TEST_SCHEMA = "ci95_low double, ci95_high double, paired_t_p double, tost_p double, smallest_margin_pct double, wilcoxon_p double"


def agreement(df: DataFrame, manual: str, automatic: str, margin_fraction: float = 0.15) -> DataFrame:
    """One row: moments, confidence interval, paired t, Wilcoxon, equivalence."""
    row = agreement_moments(df, manual, automatic, margin_fraction).crossJoin(signed_ranks(df, manual, automatic))

    def tests(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                n, mean, se = r.n, r.bias, (r.sd or math.nan) / math.sqrt(r.n) if r.n > 1 else math.nan
                if n < 2 or not se > 0:
                    out.append((None,) * 6)
                    continue
                t90, t95 = t_ppf(0.95, n - 1), t_ppf(0.975, n - 1)
                k, w = r.nonzero, min(r.w_plus, r.w_minus)
                if n < 5 or not k:
                    p = None
                elif not r.ties and k == n and n <= 50:
                    p = _exact_signed_rank_p(w, k)
                else:
                    spread = math.sqrt(max(1e-12, (k * (k + 1) * (2 * k + 1) - r.ties / 2) / 24))
                    p = math.erfc(abs(w - k * (k + 1) / 4) / spread / math.sqrt(2))
                out.append(
                    (
                        mean - t95 * se, mean + t95 * se, 2 * (1 - t_cdf(abs(mean / se), n - 1)),
                        max(1 - t_cdf((mean + r.margin) / se, n - 1), t_cdf((mean - r.margin) / se, n - 1)),
                        100 * max(abs(mean - t90 * se), abs(mean + t90 * se)) / r.manual_mean, p,
                    )
                )
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(out, columns=[c.split()[0] for c in TEST_SCHEMA.split(", ")], dtype=float)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in row.schema) + ", " + TEST_SCHEMA
    return row.mapInPandas(tests, schema)


def calibrate_leave_one_out(counts: DataFrame, option: Sequence[str] = ("option",), session: str = "session_id") -> DataFrame:
    """For every session the option with the least mean relative error over the
    others, the first of equals; counts: session, option..., truth, counted.

    The mean over the others is (sum over all - own) / (n - 1): no loop.
    """
    err = F.abs(F.col("counted") - F.col("truth")) / F.col("truth")
    own = counts.withColumn("_e", err)
    total = own.groupBy(*option).agg(F.sum("_e").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    rest = own.join(total, list(option)).withColumn("_rest", F.round((F.col("_sum") - F.col("_e")) / (F.col("_n") - 1), 9))
    best = rest.groupBy(session).agg(F.min(F.struct("_rest", *option, "counted", "truth")).alias("_b"))
    return best.select(
        session, *(F.col(f"_b.{o}") for o in option), F.col("_b.truth").alias("truth"), F.col("_b.counted").alias("counted"),
        (100 * (F.col("_b.counted") - F.col("_b.truth")) / F.col("_b.truth")).alias("error_pct"),
    )


def reference_counts(
    episodes: DataFrame, arrivals: DataFrame, layer: DataFrame, reference: DataFrame, windows: Mapping[str, int], keys: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Counts and distances after arrival against a reference, one row per key of
    the reference: for every window, count_ (episodes that begin in it), distance_
    (px moved), ratio_ (count over the reference's) and px_per_m_.

    episodes: keys, start; arrivals: keys, arrival; layer: keys, pos, distance, of
    which the row at the arrival and the last one of each window are read; all in
    rows. reference: keys, and reference_ and metres_ per window. windows: rows.
    """
    keys = list(keys)
    came = episodes.join(arrivals, keys).withColumn("_since", F.col("start") - F.col("arrival"))
    counts = came.groupBy(*keys).agg(*(F.count_if((F.col("_since") >= 0) & (F.col("_since") < rows)).alias(f"count_{w}") for w, rows in windows.items()))
    own = layer.join(arrivals, keys).withColumn("_since", F.col("pos") - F.col("arrival")).filter(F.col("_since") >= 0)
    # the distance only grows: its greatest value in a window is that of its last row
    moved = own.groupBy(*keys).agg(
        *((F.max(F.when(F.col("_since") < rows, F.col("distance"))) - F.min("distance")).alias(f"distance_{w}") for w, rows in windows.items())
    )
    out = reference.join(arrivals, keys).join(counts, keys, "left").join(moved, keys, "left").na.fill(0, [f"count_{w}" for w in windows])
    for w in windows:
        out = out.withColumn(f"ratio_{w}", ratio(F.col(f"count_{w}"), F.col(f"reference_{w}"), None))
        out = out.withColumn(f"px_per_m_{w}", ratio(F.col(f"distance_{w}"), F.col(f"metres_{w}"), None))
    return out


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r; null where one side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def reference_summary(counts: DataFrame, windows: Sequence[str]) -> DataFrame:
    """(window, correlation, median_ratio, px_per_m, px_correlation) of
    reference_counts() over all its rows."""
    parts = []
    for w in windows:
        c = {n: F.col(f"{n}_{w}").cast("double") for n in ("count", "reference", "ratio", "px_per_m", "distance", "metres")}
        parts.append(
            F.struct(
                F.lit(w).alias("window"), correlation(c["count"], c["reference"]).alias("correlation"), F.percentile(c["ratio"], F.lit(0.5)).alias("median_ratio"),
                F.percentile(c["px_per_m"], F.lit(0.5)).alias("px_per_m"), correlation(c["distance"], c["metres"]).alias("px_correlation"),
            )
        )
    return counts.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_r")).select("_r.*")
