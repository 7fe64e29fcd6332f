"""URL filter, filter interaction and source divergence against plain versions."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinetrail.llm import divergence, filter_audit, url_filter
from kinetrail.llm.common import scratch_path

from .helpers import LOWER, WORD, edge_texts, prose

DOCS = "doc_id long, text string, source string, lang string, part string, flags int, n long"


def write_files(spark, rows, path, cuts=1):
    for i in range(cuts):
        spark.createDataFrame(rows[i::cuts] if cuts > 1 else rows, DOCS).coalesce(1).write.mode("append").parquet(path)


# -- filter interaction -------------------------------------------------------


def plain_audit(rows, labels):
    """{(part, order, step): figures} as the definitions read."""
    smallest = {}
    for doc, text, *_ in rows:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    good, toxic = defaultdict(bool), defaultdict(bool)
    for doc, q, t in labels:
        good[doc] |= q == 1
        toxic[doc] |= t == 1
    parts = defaultdict(list)
    for doc, text, source, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc is not None and doc > smallest[text],
        }
        parts[source or ""].append((fails, doc is not None and good[doc], doc is not None and toxic[doc]))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for fails, _, _ in docs:
                hit = next((f for f in order if fails[f]), None)
                if hit:
                    shapley[hit] += 1
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                f, before = order[step - 1], order[: step - 1]
                left = [d for d in docs if not any(d[0][x] for x in before)]
                gone = [d for d in left if d[0][f]]
                out[part, order, step] = (
                    len(left) - len(gone), len(gone), sum(d[0][f] for d in docs) - len(gone),
                    sum(d[0][f] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), shapley[f],
                )
    return out


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def as_dict(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIGURES) for r in df.collect()}


def audit_rows(seed, n=120):
    rng = random.Random(seed)
    texts = [" ".join(prose(i, rng.choice([3, 60, 80]))) for i in range(25)]
    texts += ["A B c " * 30, "# " + texts[0], "HELLO " + texts[1], "a " * 70, *edge_texts()]
    rows = [(i, rng.choice(texts), rng.choice(["x", "y", None]), "en", "p", 1, 1) for i in range(n)]
    rows += [(None, texts[3], "x", "en", "p", 1, 1)] * 3 + [(5, texts[2], "y", "en", "p", 1, 1), rows[7], rows[7]]
    rng.shuffle(rows)
    return rows


LABELS = [(i, i % 3 and 1, i % 5 == 0 and 1 or 0) for i in range(0, 120, 2)] + [(4, 1, None), (6, None, 1), (None, 1, 1), (2, 0, 0)]


def test_later_files_retract(spark):
    """Smaller ids come last: every batch takes masks back."""
    rows = sorted(audit_rows(1), key=lambda r: -(r[0] if r[0] is not None else 1000))
    path, folder = scratch_path(spark, "docs"), scratch_path(spark, "audit")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    for i in range(0, len(rows), 40):
        write_files(spark, rows[i : i + 40], path)
    filter_audit.update_counters(spark, path, labels, folder, shards=3, files_per_batch=1)
    batches = spark.read.schema("n long").parquet(f"{folder}/counters").filter("n < 0").count()
    assert batches > 0
    assert as_dict(filter_audit.report(spark, folder)) == plain_audit(rows, LABELS)
    # new files go on from the state
    more = audit_rows(2, 40)
    write_files(spark, more, path)
    filter_audit.update_counters(spark, path, labels, folder)
    assert as_dict(filter_audit.report(spark, folder)) == plain_audit(rows + more, LABELS)


def test_audit_of_an_empty_table_and_a_hot_text(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = scratch_path(spark, "docs")
    write_files(spark, [], path)
    assert filter_audit.audit(spark, path, labels).count() == 0
    rows = [(i, "same text", "x", "en", "p", 1, 1) for i in range(3000)] + [(-1, "other", None, "en", "p", 1, 1)]
    path = scratch_path(spark, "docs")
    write_files(spark, rows, path, 3)
    assert as_dict(filter_audit.audit(spark, path, labels, files_per_batch=1)) == plain_audit(rows, [])


# -- source divergence --------------------------------------------------------


def plain_divergence(rows, least):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, source, lang, *_ in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731,B023
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("tile,block", [(32, 4096), (2, 3)])
def test_divergence(spark, monkeypatch, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = random.Random(3)
    words = [w.title() if i % 3 else w for i, w in enumerate(prose(5, 70))] + ["Über", "übeR", "straße", "日本語", "Ꞷ"]
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "de", None])
        text = "-4 ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["\x00\x7f", "_[`{~", "é"])
        rows.append((i, text, rng.choice(["a", "b", "c", "ß", None]), lang, "p", 1, 1))
    rows += [(i, t, "edge", "en", "p", 1, 1) for i, t in enumerate(edge_texts())] + [(1, None, "void", "fr", "p", 1, 1), (2, "x", "void2", "fr", "p", 1, 1)]
    rows += [(3, "alone", "one", "it", "p", 1, 1)] + [rows[0]] * 3
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = divergence.divergence(df, 4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == plain_divergence(rows, 4)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact(spark):
    rows = [(3_000_000_000_000_001, 9_000_000_000_000_007, 70_001), (0, 0, 3), (0, 0, 0)]
    df = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")))
    assert [r[0] for r in df.collect()] == [1 + 10**9 * (c + 5) // (n + 5 * v) if v else 0 for c, n, v in rows]


# -- url filter ---------------------------------------------------------------


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    return host.translate(LOWER), re.match("[^?#]*", rest[len(host) :]).group()


def plain_segments(path):
    plain = re.sub(r"(?i)(?<![a-z0-9])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![a-z0-9])", "#", path)
    return [s for s in re.sub("[0-9]+", "#", plain).split("/") if s]


def plain_tree(urls, labelled):
    """{(host, segments): (template, purity)}, host by host, branch by branch."""
    hosts = defaultdict(lambda: defaultdict(lambda: [0, 0.0, 0.0]))
    for url in urls:
        host, path = plain_split(url)
        at = hosts[host][tuple(plain_segments(path))]
        at[0] += 1
        if set(re.split("[.-]", host)) & set(url_filter.SPAM_WORDS):
            at[2] += url_filter.SPAM_LABELS
    for url, good in labelled:
        if good is not None:
            host, path = plain_split(url)
            hosts[host][tuple(plain_segments(path))][1 if good else 2] += 1
    totals = [sum(p[i] for paths in hosts.values() for p in paths.values()) for i in (1, 2)]
    base = totals[0] / sum(totals) if sum(totals) else 1.0
    smooth = lambda g, b, prior: (g + url_filter.PRIOR * prior) / (g + b + url_filter.PRIOR)
    bound = math.sqrt(0.5 * math.log(2 / url_filter.ALPHA))
    found = {}

    def split(host, paths, level, node, purity):
        if level == url_filter.DEPTH or all(len(p) <= level for p in paths):
            found.update({(host, p): (node, purity) for p in paths})
            return
        kids, pages = defaultdict(list), sum(v[0] for v in paths.values())
        for p in paths:
            kids[p[level] if len(p) > level else ""].append(p)
        few = defaultdict(list)
        for name, own in kids.items():
            n = sum(paths[p][0] for p in own)
            few["*" if name and (n < url_filter.LEAST_PAGES or n < url_filter.SHARE * pages) else name] += own
        rows = []
        for name, own in few.items():
            g, b = (sum(paths[p][i] for p in own) for i in (1, 2))
            rows.append((g / (g + b) if g + b else 2.0, name, g, b))
        merged = []
        for _, name, g, b in sorted(rows):
            if merged:
                names, mg, mb = merged[-1]
                both = g + b and mg + mb
                near = both and abs(g / (g + b) - mg / (mg + mb)) <= bound * (1 / math.sqrt(g + b) + 1 / math.sqrt(mg + mb))
                if near or not (g + b or mg + mb):
                    merged[-1] = (names + [name], mg + g, mb + b)
                    continue
            merged.append(([name], g, b))
        for names, g, b in merged:
            title = names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}"
            own = {p: paths[p] for name in names for p in few[name]}
            split(host, own, level + 1, node if title == "" else node + "/" + title, smooth(g, b, purity))

    for host, paths in hosts.items():
        split(host, paths, 0, "", smooth(*(sum(v[i] for v in paths.values()) for i in (1, 2)), base))
    return found


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def site_urls(seed):
    rng = random.Random(seed)
    urls = []
    for _ in range(900):
        host = rng.choice(["big.example.net"] * 6 + ["A.Example.org", "b.example.com", "blog.casino-win.example.net", "com", "notorg"])
        section = rng.choice(["en", "fr", "de", "es", "junk", f"tag-{rng.randint(1, 200)}", "x" + "".join(rng.choices("abcxyz", k=6))])
        tail = rng.choice(["/{n}", "/{n}.html", "/{n}/", "/a/b/c/d/e/f/g/{n}", "", "/deadbeef{n}00", "/p{n}?q=/1", "#/x", "/{n}/1/{n}"])
        urls.append(f"http://{host}/{section}{tail.format(n=rng.randint(1, 300))}")
    return urls + [None, "", "no scheme", "http://", "http://org", "http://ORG/", "x://a://b/c", "https://com/fr/é 1", "http://h\n/p\n/1", urls[0], urls[0]]


def test_url_filter(spark):
    urls = site_urls(4)
    labelled = [(u, "junk" not in u and i % 7 != 0) for i, u in enumerate(urls) if u and i % 3 == 0]
    labelled += [("http://elsewhere.net/1", False), (urls[1], None), (None, True)]
    pages = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, node string, n int")
    got = url_filter.judge(pages.repartition(4), spark.createDataFrame(labelled, "url string, good boolean"), RULES).collect()
    tree = plain_tree(urls, labelled)
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    seen = Counter()
    for r in got:
        host, path = plain_split(urls[r.page_id])
        template, purity = tree[host, tuple(plain_segments(path))]
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1])
        assert r.template == template and abs(r.purity - purity) < 1e-9
        assert r.verdict == (rule[2] if rule else "block" if purity < 0.5 else "allow")
        seen[host, r.verdict, rule is None] += 1
        if "junk" in path and host == "big.example.net":
            assert r.verdict == "block"
    assert seen["big.example.net", "allow", True] > 300 and not seen["blog.casino-win.example.net", "allow", True]
    assert any("{" in r.template for r in got) and any("*" in r.template for r in got)


def test_url_filter_without_labels_or_pages(spark):
    labels = spark.createDataFrame([], "url string, good boolean")
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    got = url_filter.judge(pages, labels)
    assert sorted((r.host, r.path, r.verdict) for r in got.collect()) == [("", "", "allow")] + [("a.b", "/c", "allow")] * 2
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_labels_by_number(spark):
    urls = ["http://a/en/17.html?x=3", "http://a/9/b", "http://a/b", None, "http://a7/", "http://a/99999999999999999999"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(17, 1, 0), (9, 1, 1), (3, 1, 0), (7, 1, 0), (9, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = url_filter.labels_by_number(pages, labels).collect()
    assert sorted((r.url, str(r.good)) for r in got) == [(urls[1], "False"), (urls[1], "None"), (urls[0], "True")]
