"""URL filter: a tree of path templates per host, judged by labelled urls.

Paths are cut into segments and counted per host, numbers and ids in them
replaced by #, so that the tree works on distinct paths and not on pages. The
tree grows level by level for all hosts at once:

* a segment that few of the parent's pages have (SHARE, LEAST_PAGES) is variable
  and goes into the wildcard *; so a node has 1 / SHARE + 1 branches at most;
* branches whose labelled purity does not differ by a Hoeffding bound are merged,
  in the order of purity, each with the pooled branch before it; branches without
  labels are merged with each other;
* the purity of a branch is smoothed by that of its parent, that of a host by the
  share of good labels in all.

A template of too little purity is rejected. Rules (host, path, verdict) go
before: a rule fits its host and all subdomains and every path that begins with
its own; the longest wins.

Defined results: host and path of a null url, or of one without ://, are empty;
such rows form a template of their own; a labelled url that is no page counts
too, a repeated one each time; labels that are null take no part; without labels
all templates are pure; a path beyond DEPTH segments belongs to the template of
its first ones; repeated pages are judged each; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

Rule = tuple[str, str, str]

#: (host, path, verdict); the operator's default has none.
RULES: Sequence[Rule] = ()
#: Levels of the tree.
DEPTH = 6
#: Part and number of the parent's pages from which on a segment is a branch.
SHARE, LEAST_PAGES = 1 / 32, 8
#: Chance of telling two branches apart that are alike.
ALPHA = 0.05
#: Labels that the purity of the parent counts for.
PRIOR = 8.0
LEAST_PURITY = 0.5
#: Words of a host's name (cut at . and -) that speak for spam, and the bad
#: labels that each page of such a host counts for.
SPAM_WORDS = (
    "ads", "adserver", "adult", "bet", "bets", "betting", "casino", "cialis", "escort", "gambling", "nude", "pills", "poker", "porn",
    "sex", "slots", "spam", "viagra", "warez", "xxx",
)
SPAM_LABELS = 16.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ://, up to /, ?, # or the end, in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def segments(path: Column) -> Column:
    """Segments of a path without empty ones; ids and numbers become #."""
    plain = F.regexp_replace(path, r"(?i)(?<![a-z0-9])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![a-z0-9])", "#")
    return F.filter(F.split(F.regexp_replace(plain, "[0-9]+", "#"), "/"), lambda s: s != "")


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null. For a list that a
    person writes: it becomes part of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own_host, own_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(own_path))
        rule = F.when(fits, F.lit(own_host + own_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def count_paths(pages: DataFrame, labelled: DataFrame, url_col: str = "url") -> DataFrame:
    """(host, place, n, good, bad): pages and labels of every distinct path;
    place: its segments, joined."""
    at = lambda url: (host_of(url).alias("host"), F.array_join(segments(path_of(url)), "/").alias("place"))
    zero, one = F.lit(0.0), F.lit(1.0)
    seen = pages.select(*at(pages[url_col]), F.lit(1).cast("long").alias("n"), zero.alias("good"), zero.alias("bad"))
    told = labelled.filter(labelled["good"].isNotNull())
    told = told.select(
        *at(told["url"]), F.lit(0).cast("long").alias("n"),
        F.when(told["good"], one).otherwise(zero).alias("good"), F.when(told["good"], zero).otherwise(one).alias("bad"),
    )
    counted = seen.unionByName(told).groupBy("host", "place").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    spam = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, SPAM_WORDS)))
    return counted.withColumn("bad", F.col("bad") + F.when(spam, SPAM_LABELS * F.col("n")).otherwise(zero))


#: Merges an array of branches, sorted by purity, into pooled ones.
_MERGE = """
    aggregate(_kids, cast(array() as array<struct<good:double,bad:double,names:array<string>>>), (acc, k) ->
      case when size(acc) > 0 and (
          (k.good + k.bad = 0 and element_at(acc, -1).good + element_at(acc, -1).bad = 0)
          or abs(try_divide(k.good, k.good + k.bad)
                 - try_divide(element_at(acc, -1).good, element_at(acc, -1).good + element_at(acc, -1).bad))
             <= {bound} * (try_divide(1d, sqrt(k.good + k.bad))
                           + try_divide(1d, sqrt(element_at(acc, -1).good + element_at(acc, -1).bad))))
        then concat(slice(acc, 1, size(acc) - 1), array(named_struct(
          'good', element_at(acc, -1).good + k.good, 'bad', element_at(acc, -1).bad + k.bad,
          'names', concat(element_at(acc, -1).names, array(k.name)))))
        else concat(acc, array(named_struct('good', k.good, 'bad', k.bad, 'names', array(k.name)))) end)
"""


def _branches(level: DataFrame) -> DataFrame:
    """(host, node, names, branch, good, bad) of every node of a level: which
    segments (or *) lie in which branch. level: (host, node, segment, n, good, bad)."""
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    kids = level.groupBy("host", "node", "segment").agg(*sums)
    pages = kids.groupBy("host", "node").agg(F.sum("n").alias("pages"))
    rare = (F.col("n") < LEAST_PAGES) | (F.col("n") < SHARE * F.col("pages"))
    # the end of a path is no segment
    named = kids.join(pages, ["host", "node"]).withColumn("name", F.when(rare & (F.col("segment") != ""), "*").otherwise(F.col("segment")))
    few = named.groupBy("host", "node", "name").agg(*sums)
    rate = F.coalesce(F.try_divide("good", F.col("good") + F.col("bad")), F.lit(2.0))
    # 1 / SHARE segments, * and the end at most
    listed = few.groupBy("host", "node").agg(F.array_sort(F.collect_list(F.struct(rate.alias("rate"), "name", "good", "bad"))).alias("_kids"))
    bound = math.sqrt(0.5 * math.log(2 / ALPHA))
    merged = listed.select("host", "node", F.explode(F.expr(_MERGE.format(bound=bound))).alias("_b"))
    names = F.array_sort("_b.names")
    title = F.when(F.size(names) == 1, names[0]).otherwise(F.concat(F.lit("{"), F.array_join(names, "|"), F.lit("}")))
    return merged.select("host", "node", names.alias("names"), title.alias("branch"), "_b.good", "_b.bad")


def grow(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, place, template, purity) of every distinct path of count_paths()."""
    paths = materialise(paths, "url-paths")
    facts = paths.agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max(F.size(F.split("place", "/"))).alias("levels")
    ).first()
    labels = (facts["good"] or 0.0) + (facts["bad"] or 0.0)
    base = facts["good"] / labels if labels else 1.0
    smooth = lambda good, bad, prior: (good + PRIOR * prior) / (good + bad + PRIOR)
    hosts = paths.groupBy("host").agg(F.sum("good").alias("_g"), F.sum("bad").alias("_b"))
    purity = smooth(F.col("_g"), F.col("_b"), F.lit(base)).alias("purity")
    tree = paths.join(hosts, "host").select(paths["host"], "place", "n", "good", "bad", F.lit("").alias("node"), purity)
    tree = materialise(tree, "url-tree-0")
    for level in range(min(depth, facts["levels"] or 0)):
        here = tree.withColumn("segment", F.coalesce(F.get(F.split("place", "/"), level), F.lit("")))
        found = _branches(here)
        named = found.groupBy("host", "node").agg(
            F.map_from_entries(
                F.flatten(F.collect_list(F.transform("names", lambda name: F.struct(name, F.struct("branch", "good", "bad")))))
            ).alias("_own"),
            F.count(F.lit(1)).alias("_branches"),
        )
        own = F.coalesce(F.try_element_at("_own", "segment"), F.try_element_at("_own", F.lit("*")))
        tree = here.join(named, ["host", "node"]).withColumn("_to", own).select(
            "host", "place", "n", "good", "bad",
            F.when(F.col("_to.branch") == "", F.col("node")).otherwise(F.concat("node", F.lit("/"), "_to.branch")).alias("node"),
            # where all paths have ended, the node is its own only branch
            F.when((F.col("_to.branch") == "") & (F.col("_branches") == 1), F.col("purity"))
            .otherwise(smooth(F.col("_to.good"), F.col("_to.bad"), F.col("purity"))).alias("purity"),
        )
        tree = materialise(tree, f"url-tree-{level + 1}")
    return tree.select("host", "place", F.col("node").alias("template"), "purity")


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page.

    labelled: url and good, urls that are known to be worth it or not.
    """
    templates = grow(count_paths(pages, labelled, url_col))
    url = pages[url_col]
    slim = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    slim = slim.withColumn("place", F.array_join(segments(F.col("path")), "/"))
    # one row per path on the right: AQE splits the partition of a hot path on the left
    joined = slim.join(templates.withColumnsRenamed({"host": "_host", "place": "_place"}), (F.col("host") == F.col("_host")) & (F.col("place") == F.col("_place")))
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "template", "purity")


def labels_by_number(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, good) of pages whose path ends in the id of a labelled document, as
    a number; good: quality 1 and not toxic."""
    number = F.expr(f"try_cast(regexp_extract(regexp_extract({url_col}, '://[^/?#]*([^?#]*)', 1), '([0-9]+)[^0-9]*$', 1) as bigint)")
    named = pages.select(url_col).withColumn("_number", number).filter("_number is not null")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    told = labels.select(F.col("doc_id").cast("long").alias("_id"), good.alias("good"))
    return named.join(told, F.col("_number") == F.col("_id")).select(F.col(url_col).alias("url"), "good")
