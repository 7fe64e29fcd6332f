"""Every stage of the pipeline against a plain version on its own input."""

import corpus_pipeline
from kinetrail.llm.common import materialise, table

from . import helpers as H
from .test_dedup import plain_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, SF), "test-stage")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    rows = {n: ([r.asDict() for r in a.collect()], [r.asDict() for r in b.collect()]) for n, (a, b) in seen.items()}

    before, after = rows["quality classifier"]
    truth = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in after}
    assert sum(d in kept for d, q in truth.items() if q == 1) >= 0.97 * sum(truth.values())
    assert 0 < len(after) < len(before)

    before, after = rows["exact dedup"]
    plan = plain_dedup([r["text"] for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({before[k]["doc_id"] for k, _, _ in best_first(before, plan)})

    before, after = rows["n-gram Jaccard join"]
    ordered = sorted(before, key=lambda r: r["doc_id"])
    parts = H.components([r["text"] for r in ordered])
    assert sorted(r["doc_id"] for r in after) == sorted(ordered[p]["doc_id"] for p in set(parts))

    before, after = rows["mixing"]
    words = lambda rs: sum(len(H.WORD.findall(r["text"])) for r in rs)
    assert abs(words(after) - 1.5 * words(before)) < 0.02 * words(before)
    before, after = rows["packing"]
    assert sum(r["length"] for r in after if r["start"] == 0) > 0
    assert sum(1 for r in after if r["start"] == 0) == len(before)


def best_first(before, plan):
    """plain_dedup() breaks ties by position; the stage by doc_id."""
    groups = {}
    for i, (_, n, digest) in plan.items():
        groups.setdefault(digest, []).append(i)
    for digest, members in groups.items():
        best = min(members, key=lambda i: (-len(before[i]["text"] or ""), before[i]["doc_id"]))
        yield best, len(members), digest


def test_nulls_and_repeated_rows(spark):
    words = " ".join(H.prose(3, 60))
    rows = [(1, words, "en", "a", 9), (1, words, "en", "a", 9), (None, words, None, None, None), (2, None, "en", "a", 0), (None, "", "en", None, None),
            (3, words + " more", "en", "b", 9), (None, "other text of some words that stand alone here", "en", "b", 9), (4, "x", "en", None, 1), (4, "x", "en", None, 1)]
    docs = spark.createDataFrame(rows, H.SCHEMA).selectExpr("*", "'c' as kept", "1 as _uid", "'d' as block")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-edges")
        seen.append([r.asDict() for r in docs.collect()])
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    kept, exact, near, mixed, packed = seen
    assert {r["doc_id"] for r in kept} <= {1, 2, 3, 4, None}
    texts = lambda rs: sorted((r["text"] or "") for r in rs)
    assert texts(exact) == sorted({r["text"] or "" for r in kept})
    alike = [t for t in texts(exact) if t.startswith(words)]
    assert len(near) == len(exact) - max(0, len(alike) - 1)
    assert {r["text"] for r in mixed} <= set(texts(near)) - {""}
    assert sum(r["start"] == 0 for r in packed) == len(mixed)


def test_empty_table(spark):
    docs = spark.createDataFrame([], H.SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0, name


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
