"""Queries of metrics, agreement statistics and clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_notable, label_set, primary_label
from ..operators import clips as CL
from ..operators import detectors, intervals, metrics, statistics
from ..sources.scratch import written
from . import standins as S
from .interval_queries import MATRIX, labelled
from .registry import bout_list, filled, query, sustain
from .series_queries import ARRIVAL, MOVE, RULES, T, TRI, arrived, layer, r6, rsql, triaged

MARKS = S.with_(marks=S.MARKS_SQL)
MX = S.with_(marks=S.MARKS_SQL, mx=f"select *, (frame+session_id)%4 as rule from {MATRIX}")
KINDS = ("click", "purchase", "search", "view_")


def ruled(spark, sf) -> DataFrame:
    """The label matrix and a rule's one-hot prediction."""
    df = labelled(spark, sf).withColumnRenamed("view", "view_").withColumn("rule", F.expr("(frame + session_id) % 4"))
    return df.withColumns({f"pred_{k}": F.col("rule") == i for i, k in enumerate(KINDS)})


def per_kind(text: str) -> str:
    return " union all ".join(text.format(k=k, i=i) for i, k in enumerate(KINDS))


@query(MX + "select behavior, tp, fp, fn, tn, round(coalesce((tp+fn)/nullif(tp+fp+fn+tn, 0), 0), 6) as prevalence, round(coalesce(tp/nullif(tp+fp, 0), 0), 6) as \"precision\", round(coalesce(tp/nullif(tp+fn, 0), 0), 6) as recall, round(coalesce(2*tp/nullif(2*tp+fp+fn, 0), 0), 6) as f1 from ("
    + per_kind("select '{k}' as behavior, count(*) filter ({k} and rule={i}) as tp, count(*) filter (not {k} and rule={i}) as fp, count(*) filter ({k} and rule<>{i}) as fn, count(*) filter (not {k} and rule<>{i}) as tn from mx where scorable") + ")")
def frame_metrics(spark, sf):
    out = metrics.frame_metrics(ruled(spark, sf), KINDS)
    return out.select("behavior", "tp", "fp", "fn", "tn", *r6("prevalence", "precision", "recall", "f1"))


@query(MX + " union all ".join(f"select '{a}' as a, '{b}' as b, round(coalesce(count(*) filter ({a} and {b})/nullif(count(*), 0), 0), 6) as share from mx where scorable" for a in KINDS for b in KINDS))
def cooccurrence(spark, sf):
    return metrics.cooccurrence(ruled(spark, sf), KINDS).select("a", "b", *r6("share"))


MANY = "(" + "+".join(f"{k}::int" for k in KINDS) + ")"


@query(MX + f"select round(coalesce(avg(({MANY}>1)::int), 0), 6) as multilabel_rate from mx where scorable")
def multilabel_rate(spark, sf):
    return metrics.multilabel_rate(ruled(spark, sf), KINDS).select(*r6("multilabel_rate"))


@query(MX + per_kind(f"select '{{k}}' as behavior, count(*) filter ({{k}}) as frames, count(*) filter ({{k}} and {MANY}>1) as frames_shared, round(coalesce(100.0*count(*) filter ({{k}} and {MANY}>1)/nullif(count(*) filter ({{k}}), 0), 0), 6)::double as unreachable_pct from mx where scorable"))
def unreachable_recall(spark, sf):
    return metrics.unreachable_recall(ruled(spark, sf), KINDS).select("behavior", "frames", "frames_shared", *r6("unreachable_pct"))


@query(MX + "select session_id, frame, " + ", ".join(f"rule={i} as {k}" for i, k in enumerate(KINDS)) + " from mx")
def rule_one_hot(spark, sf):
    from ..functions.scalars import one_hot

    return ruled(spark, sf).select("session_id", "frame", *one_hot("rule", KINDS).values())


@query(S.with_(m=S.MASKS_SQL) + """select session_id, count(*) as recorded, max(frame)-min(frame)+1 as span, round(count(*)/(max(frame)-min(frame)+1), 6) as ratio, max(g) as largest_gap
    from (select *, coalesce(frame-lag(frame) over (partition by session_id order by frame), 0) as g from m) group by 1""")
def coverage(spark, sf):
    return metrics.coverage(S.masks(spark, sf)).select("session_id", "recorded", "span", *r6("ratio"), "largest_gap")


# --- episodes --------------------------------------------------------------
#: Greedy matching by its definition: a recursion over the ranked pairs.
PAIRS = """tb as (select session_id, "start" as s, "end" as e, row_number() over (partition by session_id order by "start") - 1 as i from {a}),
  pb as (select session_id, "start" as s, "end" as e, row_number() over (partition by session_id order by "start") - 1 as i from {b}),
  pr as (select *, row_number() over (partition by session_id order by {order}) as k from (
    select tb.session_id, tb.i as ti, pb.i as pi, (least(tb.e, pb.e)-greatest(tb.s, pb.s)+1)::double/(tb.e-tb.s+1+pb.e-pb.s+1-(least(tb.e, pb.e)-greatest(tb.s, pb.s)+1)) as iou
    from tb join pb on pb.session_id=tb.session_id and tb.s<=pb.e and pb.s<=tb.e) where iou >= {least}),
  walk as (select session_id, k, [ti] as ut, [pi] as up, ti, pi, iou, true as ok from pr where k=1
    union all select p.session_id, p.k, case when ok2 then list_append(w.ut, p.ti) else w.ut end, case when ok2 then list_append(w.up, p.pi) else w.up end, p.ti, p.pi, p.iou, ok2
    from walk w join lateral (select *, not list_contains(w.ut, ti) and not list_contains(w.up, pi) as ok2 from pr where pr.session_id=w.session_id and pr.k=w.k+1) p on true)"""
A, B = bout_list("m", "a"), bout_list("m", "b")
GREEDY = PAIRS.format(a=A, b=B, order="iou desc, ti desc, pi desc", least=0.5)
FIRST = PAIRS.format(a=A, b=B, order="pi, ti", least=0)
REC = "with recursive m as (" + S.MASKS_SQL + "), "


def two(spark, sf) -> tuple[DataFrame, DataFrame]:
    m = S.masks(spark, sf)
    return intervals.bouts(m, "a", ["session_id"]), intervals.bouts(m, "b", ["session_id"])


@query(REC + GREEDY + " select session_id, cast(ti as bigint) as true_index, cast(pi as bigint) as pred_index, round(iou, 6) as iou from walk where ok")
def match_bouts(spark, sf):
    a, b = two(spark, sf)
    out = metrics.match_bouts(a, b, ["session_id"], 0.5, "start", "end")
    return out.select("session_id", F.col("true_index").cast("long").alias("true_index"), F.col("pred_index").cast("long").alias("pred_index"), *r6("iou"))


@query(REC + GREEDY + """ select x.session_id, x.n as n_true, y.n as n_pred, coalesce(z.n, 0) as matched, x.t as time_true, y.t as time_pred, round(coalesce(z.n, 0)/x.n, 6) as bout_recall, round(coalesce(z.n, 0)/y.n, 6) as bout_precision,
    y.n-x.n as count_error, round(100.0*(y.t-x.t)/x.t, 6)::double as time_error_pct from (select session_id, count(*) as n, cast(sum(e-s+1) as bigint) as t from tb group by 1) x join (select session_id, count(*) as n, cast(sum(e-s+1) as bigint) as t from pb group by 1) y using (session_id)
    left join (select session_id, count(*) as n from walk where ok group by 1) z using (session_id)""")
def bout_metrics(spark, sf):
    a, b = (x.withColumnsRenamed({"start": "start_frame", "end": "end_frame"}) for x in two(spark, sf))
    out = metrics.bout_metrics(a, b, ["session_id"], ["session_id"])
    return out.select("session_id", "n_true", "n_pred", "matched", "time_true", "time_pred", *r6("bout_recall", "bout_precision"), "count_error", *r6("time_error_pct"))


@query(REC + FIRST + " select session_id, count(*) filter (ok) as matched from walk group by 1")
def matched_episodes(spark, sf):
    a, b = two(spark, sf)
    return metrics.matched_episodes(a, b)


@query(REC + FIRST + """, hit as (select session_id, count(distinct ti) as h, count(distinct pi) as r from pr group by 1)
    select f.session_id, round(ma/30e0, 6) as manual_s, round(mb/30e0, 6) as detected_s, na as manual_bouts, nb as detected_bouts, round(mab/nullif(ma, 0), 6) as frames_found, round(mab/nullif(mb, 0), 6) as frames_right,
      round(coalesce(h, 0)/nullif(na, 0), 6) as bouts_found, round(coalesce(r, 0)/nullif(nb, 0), 6) as bouts_right, coalesce(p, 0) as matched_bouts
    from (select session_id, count(*) filter (a) as ma, count(*) filter (b) as mb, count(*) filter (a and b) as mab from m group by 1) f
    join (select session_id, count(*) as na from tb group by 1) t using (session_id) join (select session_id, count(*) as nb from pb group by 1) q using (session_id)
    left join hit using (session_id) left join (select session_id, count(*) filter (ok) as p from walk group by 1) w using (session_id)""")
def compare(spark, sf):
    out = metrics.compare(S.masks(spark, sf), "a", "b")
    return out.select("session_id", *r6("manual_s", "detected_s"), "manual_bouts", "detected_bouts", *r6("frames_found", "frames_right", "bouts_found", "bouts_right"), "matched_bouts")


# --- paired totals ---------------------------------------------------------
PAIRED = "select l_suppkey as session_id, cast(count(*) filter (l_returnflag='R') as double) as manual, cast(count(*) filter (l_linestatus='F' and l_quantity<26) as double) as automatic from {li} group by 1"
PR = S.with_(pr=PAIRED.replace("{li}", "lineitem"))


def paired(spark, sf) -> DataFrame:
    text = PAIRED.replace("{li}", "{lineitem}").replace("count(*) filter (l_returnflag='R')", "count_if(l_returnflag='R')").replace("count(*) filter (l_linestatus='F' and l_quantity<26)", "count_if(l_linestatus='F' and l_quantity<26)")
    return spark.sql(text, lineitem=S.read(spark, sf, "lineitem"))


@query(PR + """select count(*) as n, round(avg(e*e), 6) as mse, round(sqrt(avg(e*e)), 6) as rmse, round(avg(e), 6) as bias, round(var_pop(e), 6) as spread, round(avg(e)*avg(e)/avg(e*e), 6) as bias_share, round(avg(manual), 6) as manual_mean,
    round(quantile_cont(abs(e)/greatest(manual, 1), 0.5), 6) as relative_median, (select session_id from pr order by (automatic-manual)*(automatic-manual) desc, session_id limit 1) as worst_session, round(max(e*e)/sum(e*e), 6) as worst_share
    from (select *, automatic-manual as e from pr)""")
def total_error(spark, sf):
    out = statistics.total_error(paired(spark, sf), "manual", "automatic", "session_id")
    return out.select("n", *r6("mse", "rmse", "bias", "spread", "bias_share", "manual_mean", "relative_median"), "worst_session", *r6("worst_share"))


CCC = "2*covar_pop(manual, automatic)/(var_pop(manual)+var_pop(automatic)+(avg(manual)-avg(automatic))*(avg(manual)-avg(automatic)))"


@query(PR + f"select round({CCC}, 6) as ccc from pr")
def concordance(spark, sf):
    return statistics.concordance(paired(spark, sf), "manual", "automatic").select(*r6("ccc"))


@query(PR + f"""select count(*) as n, round(avg(manual), 6) as manual_mean, round(avg(automatic), 6) as automatic_mean, round(avg(d), 6) as bias, round(stddev_samp(d), 6) as sd, round({CCC}, 6) as ccc, round(corr(manual, automatic), 6) as pearson_r,
    round(100*avg(case when manual>0 then abs(d)/manual end), 6) as mean_abs_pct_error, round(100*avg(d)/avg(manual), 6) as bias_pct, round(0.15*avg(manual), 6) as margin, round(avg(d)-1.96*stddev_samp(d), 6) as limit_low, round(avg(d)+1.96*stddev_samp(d), 6) as limit_high
    from (select *, automatic-manual as d from pr)""")
def agreement_moments(spark, sf):
    out = statistics.agreement_moments(paired(spark, sf), "manual", "automatic")
    return out.select("n", *r6(*(c for c in out.columns if c != "n")))


@query(PR + """select round(coalesce(sum(rk) filter (d>0), 0), 6) as w_plus, round(coalesce(sum(rk) filter (d<0), 0), 6) as w_minus, count(*) as nonzero, cast((select coalesce(sum(n*n*n-n), 0) from (select count(*) as n from pr where automatic<>manual group by abs(automatic-manual))) as bigint) as ties
    from (select automatic-manual as d, rank() over (order by abs(automatic-manual)) + (count(*) over (partition by abs(automatic-manual)) - 1)/2e0 as rk from pr where automatic<>manual)""")
def signed_ranks(spark, sf):
    return statistics.signed_ranks(paired(spark, sf), "manual", "automatic").select(*r6("w_plus", "w_minus"), "nonzero", "ties")


@query()
def agreement(spark, sf):
    """With p-values, which need the t distribution."""
    return statistics.agreement(paired(spark, sf), "manual", "automatic")


OPTIONS = "select session_id, k as option, manual + 1 as truth, automatic * (0.5e0 + k*0.25e0) as counted from pr cross join {ks}"


@query(PR + "select session_id, option, round(truth, 6) as truth, round(counted, 6) as counted, round(100*(counted-truth)/truth, 6) as error_pct from (select *, row_number() over (partition by session_id order by round((tot-e)/(n-1), 9), option) as k from (select *, abs(counted-truth)/truth as e, sum(abs(counted-truth)/truth) over (partition by option) as tot, count(*) over (partition by option) as n from ("
    + OPTIONS.replace("{ks}", "(select unnest(range(0, 5)) as k)") + "))) where k=1")
def calibrate_loo(spark, sf):
    options = paired(spark, sf).withColumn("option", F.explode(F.expr("sequence(0L, 4L)")))
    counts = options.selectExpr("session_id", "option", "manual + 1 as truth", "automatic * (0.5e0 + option*0.25e0) as counted")
    return statistics.calibrate_leave_one_out(counts).select("session_id", "option", *r6("truth", "counted", "error_pct"))


#: Rows after arrival that are counted.
WINDOWS = {"short": 200, "long": 400}
_ROW = "r.session_id, r.arrival, r.manual, r.metres"
REFERENCE = f"""select {_ROW}, """ + ", ".join(
    f"""(select count(*) from bo b where b.session_id=r.session_id and b."start">=r.arrival and b."start"<r.arrival+{n}) as count_{w},
    (select l.distance from layer l where l.session_id=r.session_id and l.frame=least(r.arrival+{n}, r.n)-1) - (select l.distance from layer l where l.session_id=r.session_id and l.frame=r.arrival) as distance_{w}"""
    for w, n in WINDOWS.items()) + " from rf r"
REF = S.with_(**MOVE, pr=PAIRED.replace("{li}", "lineitem"), m=S.MASKS_SQL, bo=f"select * from {A}", ar=ARRIVAL,
    rf="select session_id, arrival, manual, automatic+1 as metres, n from pr join ar using (session_id) join (select session_id, count(*) as n from pose group by 1) using (session_id)", re=REFERENCE)
_EACH = ", ".join(f"count_{w}, round(distance_{w}, 3) as distance_{w}, round(count_{w}/nullif(manual, 0), 6) as ratio_{w}, round(distance_{w}/nullif(metres, 0), 6) as px_per_m_{w}" for w in WINDOWS)


def against_reference(spark, sf) -> DataFrame:
    """Episodes and distances after arrival, with the paired totals as reference."""
    a, _ = two(spark, sf)
    own = paired(spark, sf).select("session_id", *(F.col("manual").alias(f"reference_{w}") for w in WINDOWS), *((F.col("automatic") + 1).alias(f"metres_{w}") for w in WINDOWS))
    moved = layer(spark, sf).select("session_id", F.col("frame").alias("pos"), "distance")
    return statistics.reference_counts(a, arrived(spark, sf), moved, own, WINDOWS)


@query(REF + f"select session_id, arrival, {_EACH} from re")
def reference_counts(spark, sf):
    out = against_reference(spark, sf)
    return out.select("session_id", "arrival", *(x for w in WINDOWS for x in (f"count_{w}", F.round(f"distance_{w}", 3).alias(f"distance_{w}"), *r6(f"ratio_{w}", f"px_per_m_{w}"))))


@query(REF + " union all ".join(f"""select '{w}' as "window", round(corr(count_{w}, manual), 6) as correlation, round(quantile_cont(count_{w}/nullif(manual, 0), 0.5), 6) as median_ratio,
    round(quantile_cont(distance_{w}/nullif(metres, 0), 0.5), 6) as px_per_m, round(corr(distance_{w}, metres), 6) as px_correlation from re""" for w in WINDOWS))
def reference_summary(spark, sf):
    out = statistics.reference_summary(against_reference(spark, sf), list(WINDOWS))
    return out.select("window", *r6("correlation", "median_ratio", "px_per_m", "px_correlation"))


# --- clips -----------------------------------------------------------------
NAMES = "case when labels<>'' then list_distinct(string_split(labels, ';')) when also<>'' then list_distinct(list_concat([label], string_split(also, ';'))) else [label] end"
CLIP_SQL = S.CLIPS_SQL
C = dict(clips=CLIP_SQL, cn=f"select *, {NAMES} as names from clips")


def named(spark, sf) -> DataFrame:
    c = S.clips(spark, sf)
    return CL.combine_rounds(c.drop("label", "also", "labels"), c.select("clip_id", "label", "also", "labels"))


@query(S.with_(**C) + "select clip_id, list_sort(names) as names from cn")
def label_sets(spark, sf):
    return S.clips(spark, sf).select("clip_id", F.array_sort(label_set("labels", "label", "also")).alias("names"))


PRIORITY = "['object_interaction', 'rearing', 'grooming', 'other', 'sniffing', 'walking', 'still', 'unscorable']"


@query(name="primary_label", sql=S.with_(**C) + f"select clip_id, [p for p in {PRIORITY} if list_contains(names, p)][1] as primary_label from cn")
def primary_label_of(spark, sf):
    return S.clips(spark, sf).select("clip_id", primary_label(label_set("labels", "label", "also")).alias("primary_label"))


@query(S.with_(**C) + "select clip_id, list_has_any(names, ['grooming', 'rearing', 'other']) as notable, list_has_any(names, ['grooming', 'rearing', 'other', 'sniffing']) as notable_sniffing from cn")
def notable_flags(spark, sf):
    n = label_set("labels", "label", "also")
    return S.clips(spark, sf).withColumn("names", n).select("clip_id", is_notable("names").alias("notable"), is_notable("names", ["sniffing"]).alias("notable_sniffing"))


KEPT = "select * from cn where names <> ['unscorable'] and not (round='r1' and list_contains(names, 'other'))"


@query(S.with_(**C) + f"select clip_id, session_id, round, list_sort(names) as names from ({KEPT})")
def combine_rounds(spark, sf):
    return named(spark, sf).select("clip_id", "session_id", "round", F.array_sort("names").alias("names"))


def _avg(c: str) -> str:
    return f"coalesce(avg({c}::int), 0)"


PRES = ", ".join(f"{_avg(c)} as {c}, coalesce(bool_or({c}), false) as any_{c}" for c in ("review", "unscorable", "object_interaction"))
E = dict(TRI, **C, kept=KEPT, pres=f"select c.clip_id, {PRES} from kept c left join tri t on t.session_id=c.session_id and t.frame between c.start_frame and c.end_frame group by 1",
         ev="""select k.clip_id, session_id, round, band_share, triage_label as stratum, names, list_has_any(names, ['grooming', 'rearing', 'other']) as notable, review>=0.1 or unscorable>=0.1 as surfaced,
           list_contains(names, 'object_interaction') as exploration, object_interaction>=0.1 as object_detected from kept k join pres using (clip_id)""",
         wt="select stratum, share/sum(share) over () as weight from (" + " union all ".join(f"select '{s}' as stratum, avg(x) as share from (select session_id, avg({s}::int) as x from tri group by 1)" for s in ("walking", "freezing", "review")) + ")")
EV = S.with_(**E)


def evaluated(spark, sf, frames: DataFrame | None = None) -> DataFrame:
    clips, frames = named(spark, sf), triaged(spark, sf) if frames is None else frames
    pres = CL.clip_presence(frames, clips, ["review", "unscorable", "object_interaction"])
    return CL.clip_evaluation(clips, pres).join(clips.select("clip_id", "session_id", "round", "band_share"), "clip_id")


def weights(spark, sf, frames: DataFrame | None = None) -> DataFrame:
    return CL.stratum_weights(triaged(spark, sf) if frames is None else frames, ["walking", "freezing", "review"])


def flags(spark, sf) -> DataFrame:
    """The flags of triaged() as a table, for what reads them twice."""
    return written(triaged(spark, sf).select("session_id", "frame", "walking", "freezing", "object_interaction", "unscorable", "review"), "flags")


@query(EV + f"select clip_id, {', '.join(f'round({c}, 6) as {c}, any_{c}' for c in ('review', 'unscorable', 'object_interaction'))} from pres")
def clip_presence(spark, sf):
    cols = ["review", "unscorable", "object_interaction"]
    out = CL.clip_presence(triaged(spark, sf), named(spark, sf), cols)
    return out.select("clip_id", *r6(*cols), *(f"any_{c}" for c in cols))


@query(EV + "select clip_id, stratum, notable, surfaced, exploration, object_detected from ev")
def clip_evaluation(spark, sf):
    return evaluated(spark, sf).select("clip_id", "stratum", "notable", "surfaced", "exploration", "object_detected")


@query(EV + "select kind, count(*) as clips, round(avg(surfaced::int), 6) as surfaced_share from (select unnest(names) as kind, surfaced from ev where notable) group by 1")
def escape_by_kind(spark, sf):
    return CL.escape_by(evaluated(spark, sf), "names").select("kind", "clips", *r6("surfaced_share"))


@query(EV + "select stratum, round(weight, 6) as weight from wt")
def stratum_weights(spark, sf):
    return weights(spark, sf).select("stratum", *r6("weight"))


PER = "(select stratum, avg(notable::int) as t, avg((notable and not surfaced)::int) as e from ev group by 1)"


@query(EV + f"select round(sum(weight*e)/nullif(sum(weight*t), 0), 6) as weighted_escape from {PER} join wt using (stratum)")
def weighted_escape(spark, sf):
    frames = flags(spark, sf)
    return CL.weighted_escape(evaluated(spark, sf, frames), weights(spark, sf, frames)).select(*r6("weighted_escape"))


@query(EV + """select round(sum(w*tp)/nullif(sum(w*ps), 0), 6) as recall, round(sum(w*tp)/nullif(sum(w*(tp+fp)), 0), 6) as "precision" from (select stratum, min(band_share)/count(*) as w, count(*) filter (notable and surfaced) as tp,
    count(*) filter (not notable and surfaced) as fp, count(*) filter (notable) as ps from ev group by 1)""")
def weighted_rates(spark, sf):
    return CL.weighted_rates(evaluated(spark, sf), "notable", "surfaced", "stratum", "band_share").select(*r6("recall", "precision"))


@query(EV + "select round(avg(case when notable then (not surfaced)::int end), 6) as escape_all, round(avg(case when notable and round='test' then (not surfaced)::int end), 6) as escape_test, "
    + ", ".join(f"round(avg(case when list_contains(names, '{k}') then surfaced::int end), 6) as seen_{k}" for k in ("grooming", "rearing")) + " from ev")
def escape_summary(spark, sf):
    return CL.escape_summary(evaluated(spark, sf), ["grooming", "rearing"], "test").select(*r6("escape_all", "escape_test", "seen_grooming", "seen_rearing"))


DRAWS = """(select stratum, rep, n, notables, missed, cast(('0x' || substr(md5(concat(clip_id, '|', cast(rep as varchar), '|0')), 1, 12)) as bigint) % n as place from ev
    join (select stratum, count(*) as n, count(*) filter (notable) as notables, count(*) filter (notable and not surfaced) as missed from ev group by 1) using (stratum) cross join (select unnest(range(1, 2001)) as rep))"""


#: tri and ev are read several times: computed once.
@query(EV.replace("tri as (", "tri as materialized (").replace("ev as (", "ev as materialized (") + f"""select round(quantile_cont(v, 0.05), 6) as p5, round(quantile_cont(v, 0.95), 6) as p95 from (select rep, sum(weight*e)/nullif(sum(weight*t), 0) as v from (
    select rep, stratum, count(*) filter (place<missed)/min(n) as e, count(*) filter (place<notables)/min(n) as t from {DRAWS} group by 1, 2) join wt using (stratum) group by 1)""")
def bootstrap_ci(spark, sf):
    frames = flags(spark, sf)
    clips = written(evaluated(spark, sf, frames).select("clip_id", "stratum", "notable", "surfaced"), "evaluated")
    return CL.bootstrap_escape(clips, weights(spark, sf, frames)).select(*r6("p5", "p95"))


SC = S.with_(m=S.MASKS_SQL, clips=CLIP_SQL)


@query(SC + """select clip_id, case when gone>=0.1 then 'inf' when len(sc)>=k then cast(round(sc[k], 6) as varchar) else '-inf' end as score from (select clip_id, avg(missing::int) as gone, cast(ceil(0.1*count(*)-1e-9) as int) as k,
    list(score order by score desc) filter (not missing) as sc from clips c join m on m.session_id=c.session_id and m.frame between c.start_frame and c.end_frame group by 1)""")
def surfacing_score(spark, sf):
    out = CL.surfacing_score(S.masks(spark, sf), S.clips(spark, sf))
    text = F.when(F.col("score") == float("inf"), "inf").when(F.col("score") == float("-inf"), "-inf").otherwise(F.round("score", 6).cast("string"))
    return out.select("clip_id", text.alias("score"))


@query(S.with_(m=S.MASKS_SQL) + "select g as threshold, round(avg(s), 6) as skipped from (select g, session_id, 1 - count(*) filter (not missing and score>=g)/count(*) as s from m cross join (select unnest([0.1e0, 0.3e0, 0.5e0, 0.7e0, 0.9e0]) as g) group by 1, 2) group by 1")
def reduction_curve(spark, sf):
    return CL.reduction_curve(S.masks(spark, sf), [0.1, 0.3, 0.5, 0.7, 0.9]).select("threshold", *r6("skipped"))


BANDS = """select t.session_id, t.rn as tile, round(t.score, 6) as score, (t.score>=c1)::int + (t.score>=c2)::int as band from m t cross join
    (select quantile_cont(v, 0.5) as c1, quantile_cont(v, 0.8) as c2 from (select case when missing then 'inf'::double else score end as v from m)) where t.rn%30=0"""


@query(S.with_(m=S.MASKS_SQL) + f"select session_id, tile, score, cast(band as bigint) as band, round(count(*) over (partition by band)/count(*) over (), 6) as band_share from ({BANDS})")
def score_bands(spark, sf):
    m = S.masks(spark, sf)
    out = CL.score_bands(m, m.filter("rn % 30 = 0").select("session_id", F.col("rn").alias("tile"), "score"), [0.5, 0.8])
    return out.select("session_id", "tile", *r6("score"), F.col("band").cast("long").alias("band"), *r6("band_share"))


NEAREST = """(select t.*, (select o.object_id from objects o where o.session_id=t.session_id order by sqrt((t.nose_x-o.center_x)*(t.nose_x-o.center_x)+(t.nose_y-o.center_y)*(t.nose_y-o.center_y))-o.radius, o.object_id limit 1) as near_id, t.rn%40<20 as marked from ob t)"""


@query(S.with_(**{k: TRI[k] for k in ("pose", "objects", "kin", "fz", "wk", "ob")}) + f"""select session_id, round(count(*) filter (marked)/30e0, 6) as manual_s, round(count(*) filter (object_interaction)/30e0, 6) as automatic_s, round(count(*) filter (marked and object_interaction)/nullif(count(*) filter (marked), 0), 6) as found,
    round(count(*) filter (marked and object_interaction)/nullif(count(*) filter (object_interaction), 0), 6) as "right", round(count(*) filter (marked and near_id=2)/nullif(count(*) filter (marked), 0), 6) as manual_object2, round(count(*) filter (object_interaction and near_id=2)/nullif(count(*) filter (object_interaction), 0), 6) as automatic_object2 from {NEAREST} group by 1""")
def exploration_agreement(spark, sf):
    df = triaged(spark, sf).withColumn("marked", F.expr("rn % 40 < 20"))
    out = CL.exploration_agreement(df, S.objects(spark, sf), "marked", "object_interaction")
    return out.select("session_id", *r6("manual_s", "automatic_s", "found", "right", "manual_object2", "automatic_object2"))


# --- thresholds ------------------------------------------------------------
#: The grids of the threshold search.
GRID = tuple(round(0.2 + 0.05 * k, 2) for k in range(13))
FINE = tuple(round(0.01 * k, 2) for k in range(1, 96))


def threshold_counts(spark, sf, grid) -> DataFrame:
    """Per threshold and session: episodes marked, found, matched, hit."""
    m = S.masks(spark, sf)
    found = detectors.threshold_episodes(m, "score", grid, ["session_id"])
    return metrics.threshold_counts(intervals.bouts(m, "b", ["session_id"]), found, grid)


def by_threshold(grid) -> str:
    """SQL: the masks once per threshold, as sessions of their own, with the
    episodes of the marks (tb) and of the score (pb)."""
    listed = ", ".join(f"{g}e0" for g in grid)
    masks = f"select session_id*100+i as session_id, rn, frame, b, score >= t as f from m cross join (select unnest(range(0, {len(grid)})) as i, unnest([{listed}]) as t)"
    kept = sustain(filled(sustain("mm", "f", 9, "s1"), "s1", 15, "s2"), "s2", 9, "s3")
    return f"mm as materialized ({masks}), fb as materialized (select * from {bout_list(kept, 's3')}), mb as materialized (select * from {bout_list('mm', 'b')})"


MEET = """oc as (select mb.session_id, mb."start" as ti, fb."start" as pi from mb join fb on fb.session_id=mb.session_id and mb."start"<=fb."end" and fb."start"<=mb."end"),
  ct as (select x.session_id, coalesce(a.n, 0) as manual, coalesce(f.n, 0) as found, coalesce(o.h, 0) as hits, coalesce(o.r, 0) as "real" from (select distinct session_id from mm) x
    left join (select session_id, count(*) as n from mb group by 1) a using (session_id) left join (select session_id, count(*) as n from fb group by 1) f using (session_id)
    left join (select session_id, count(distinct ti) as h, count(distinct pi) as r from oc group by 1) o using (session_id))"""


def of_grid(grid) -> str:
    return f"[{', '.join(f'{g}e0' for g in grid)}][session_id%100+1]"


@query("with m as (" + S.MASKS_SQL + f"), {by_threshold(GRID)}, {MEET} select {of_grid(GRID)} as threshold, cast(sum(manual) as bigint) as episodes, cast(sum(hits) as bigint) as found, cast(sum(found-\"real\") as bigint) as false_alarms from ct group by 1")
def threshold_table(spark, sf):
    counts = threshold_counts(spark, sf, GRID)
    return counts.groupBy("threshold").agg(F.sum("manual").alias("episodes"), F.sum("hits").alias("found"), F.sum(F.col("found") - F.col("real")).alias("false_alarms"))


BY_M = "select session_id*10+i as session_id, rn, frame, b, case when i=0 then score >= 0.6e0 else a end as f from m cross join (select unnest([0, 1]) as i)"


def _totals(masks: str) -> str:
    pairs = PAIRS.format(a=bout_list("mm", "b"), b=bout_list("mm", "f"), order="pi, ti", least=0)
    return REC + f"""mm as ({masks}), {pairs}, tot as (select x.session_id, coalesce(tn, 0) as manual, coalesce(pn, 0) as found, coalesce(w, 0) as pairs, coalesce(h, 0) as hits, coalesce(r, 0) as hit_found from (select distinct session_id from mm) x
      left join (select session_id, count(*) as tn from tb group by 1) using (session_id) left join (select session_id, count(*) as pn from pb group by 1) using (session_id)
      left join (select session_id, count(*) filter (ok) as w from walk group by 1) using (session_id) left join (select session_id, count(distinct ti) as h, count(distinct pi) as r from pr group by 1) using (session_id)) """


def results(spark, sf) -> DataFrame:
    m = S.masks(spark, sf)
    one = lambda name, c: metrics.compare(m.withColumn("_p", c), "b", "_p").withColumn("method", F.lit(name))
    return one("model", F.col("score") >= 0.6).unionByName(one("rule", F.col("a")))


@query(_totals(BY_M) + """select method, round(sum(hits)/sum(manual), 6) as recall, round(sum(hit_found)/sum(found), 6) as "precision", round(sum(pairs)/sum(manual), 6) as one_to_one_recall, round(sum(pairs)/sum(found), 6) as one_to_one_precision,
    round(2*sum(pairs)/(sum(manual)+sum(found)), 6) as one_to_one_f1, round(100*(sum(found)-sum(manual))/sum(manual), 6) as count_bias_pct, round(2*(sum(hits)/sum(manual))*(sum(hit_found)/sum(found))/(sum(hits)/sum(manual)+sum(hit_found)/sum(found)), 6) as f1
    from (select *, case when session_id%10=0 then 'model' else 'rule' end as method from tot) group by 1""")
def result_summary(spark, sf):
    out = CL.result_summary(results(spark, sf))
    return out.select("method", *r6(*(c for c in out.columns if c != "method")))


@query(REC + by_threshold(GRID) + ", " + PAIRS.format(a="mb", b="fb", order="pi, ti", least=0) + f""" select {of_grid(GRID)} as threshold, round(2*sum(coalesce(w, 0))/greatest(1, sum(manual)+sum(found)), 6) as f1
    from (select session_id, manual, found, w from (select session_id, count(*) as manual from mb group by 1) full join (select session_id, count(*) as found from fb group by 1) using (session_id)
      left join (select session_id, count(*) filter (ok) as w from walk group by 1) using (session_id)) group by 1 order by round(f1, 9) desc, threshold limit 1""")
def choose_threshold(spark, sf):
    from ..operators.models import choose_threshold as choose

    return choose(threshold_counts(spark, sf, GRID)).select("threshold", *r6("f1"))


@query("with m as (" + S.MASKS_SQL + f"), {by_threshold(FINE)}, {MEET} select max(threshold) as threshold from (select {of_grid(FINE)} as threshold, sum(hits)/sum(manual) as recall from ct group by 1) where recall >= 0.6")
def threshold_for_recall(spark, sf):
    from ..operators.models import threshold_for_recall as choose

    return choose(threshold_counts(spark, sf, FINE), 0.6)
