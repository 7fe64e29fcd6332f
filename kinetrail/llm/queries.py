"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann, chat, divergence, exact_dedup, filter_audit, html_text, license_scan, mixing, ngram_join, packing, quality, token_output,
    url_filter,
)
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.training_order(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    # a second layout: one row per conversation with nested messages
    own = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.array(*(F.struct(F.lit(role).alias("role"), F.lit(said).alias("content")) for role in ("user", "assistant"))).alias("messages"),
    )
    return chat.read_back(chat.format_rows(table(spark, sf_dir, "conversations"), own))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = (
        ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
        ("com", "/fr/", "allow"), ("com", "/de/", "block"),
    )
    return url_filter.judge(pages, url_filter.labels_by_number(pages, table(spark, sf_dir, "labels")), rules)


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_nearest_neighbours,
        op3_ngram_jaccard,
        op4_license_scan,
        op5_quality,
        op6_pack,
        op7_mix,
        op8_training_order,
        op9_html_text,
        op10_chat_format,
        op11_url_filter,
        op12_filter_interaction,
        op13_source_divergence,
    )
}

#: Where SQL can express a query fully.
ORACLE_SQL = {
    "op1_exact_dedup": r"""
        with d as (
          select doc_id, coalesce(length(text), 0) as n,
                 sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', '', 'g')) as text_sha256
          from documents),
        w as (
          select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
                 count(*) over (partition by text_sha256) as group_size
          from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from w""",
    "op12_filter_interaction": r"""
        with word as (
          select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        failed as (
          select doc_id, part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
                 + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
                 + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask
          from word),
        labelled as (
          select part, mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic
          from failed left join (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id) using (doc_id)),
        masks as (
          select part, mask, bit_count(mask) as k, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
          from labelled group by part, mask),
        letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
        orders as (
          select a.c || b.c || x.c || y.c || z.c as o from letters a, letters b, letters x, letters y, letters z
          where len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
        steps as (
          select o as filter_order, step, 1 << (ascii(o[step]) - 65) as own,
                 case when step > 1 then 1 << (ascii(o[1]) - 65) else 0 end | case when step > 2 then 1 << (ascii(o[2]) - 65) else 0 end
                 | case when step > 3 then 1 << (ascii(o[3]) - 65) else 0 end | case when step > 4 then 1 << (ascii(o[4]) - 65) else 0 end as before
          from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
        judged as (
          select *, (mask & own) > 0 as mine, (mask & before) > 0 as gone from masks, steps)
        select part, filter_order, cast(step as integer) as step,
          cast(coalesce(sum(n) filter (not mine and not gone), 0) as bigint) as kept,
          cast(coalesce(sum(n) filter (mine and not gone), 0) as bigint) as removed,
          cast(coalesce(sum(n) filter (mine and gone), 0) as bigint) as redundant,
          cast(coalesce(sum(n) filter (mine and k = 1), 0) as bigint) as unique_fails,
          cast(coalesce(sum(good) filter (mine and not gone), 0) as bigint) as good_lost,
          cast(coalesce(sum(toxic) filter (mine and not gone), 0) as bigint) as toxic_lost,
          cast(coalesce(sum(n * (120 // greatest(k, 1))) filter (mine), 0) as bigint) as shapley
        from judged group by part, filter_order, step""",
    "op13_source_divergence": r"""
        with word as (
          select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
                 unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as raw from documents),
        term as (select lang, source, doc, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from word),
        kept as (select lang, term, count(*) as n from term group by lang, term having count(distinct doc) >= 30),
        langs as (select lang, cast(sum(n) as hugeint) as total, count(*) as v from kept group by lang),
        groups as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
        own as (select lang, source, term, count(*) as n from term semi join kept using (lang, term) group by all),
        totals as (select lang, source, cast(sum(n) as hugeint) as total from own group by all),
        dense as (
          select g.lang, g.source, k.term, coalesce(o.n, 0) as n,
                 1 + (cast(1000000000 as hugeint) * (coalesce(o.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) as p,
                 1 + (cast(1000000000 as hugeint) * (k.n + 5)) // (l.total + 5 * l.v) as q
          from groups g join kept k using (lang) join langs l using (lang)
          left join totals t on t.lang = g.lang and t.source = g.source
          left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
        pair as (
          select a.lang, a.source, b.source as item, cast(coalesce(sum(abs(x.p - y.p)), 0) as bigint) as value
          from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join dense x on x.lang = a.lang and x.source = a.source
          left join dense y on y.lang = b.lang and y.source = b.source and y.term = x.term
          group by all),
        both_parts as (
          select lang, source, 'pair' as part, item, value from pair
          union all
          select lang, source, 'term', term, cast(p - q as bigint) from dense where n > 0 and p > q),
        ranked as (
          select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from both_parts)
        select * from ranked where part = 'pair' or rank <= 50""",
}
