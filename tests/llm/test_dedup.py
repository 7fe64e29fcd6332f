import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import exact_dedup, ngram_join, queries
from kinetrail.llm.common import table
from kinetrail.llm.components import components
from kinetrail.llm.word_hashes import shingle_set
from tests.oracle import connect, rows

from . import helpers as H


def plain_dedup(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def test_minimal_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 256, (5000, 32), dtype=np.uint8)
    sizes, bits, slots = exact_dedup.build_mph(keys)
    assert sorted(slots) == list(range(5000))
    stored = keys[np.argsort(slots)]
    assert (exact_dedup.find_slots(keys, sizes, bits, stored) == slots).all()
    others = np.random.default_rng(1).integers(0, 256, (5000, 32), dtype=np.uint8)
    assert (exact_dedup.find_slots(others, sizes, bits, stored) == -1).all()


def test_exact_dedup_edges(spark):
    texts = H.edge_texts() + ["a bc d", "ab  cd", "A b c d"]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.exact_dedup(H.documents(spark, texts)).collect()}
    assert got == plain_dedup(texts)
    assert exact_dedup.exact_dedup(H.documents(spark, ["x"]).limit(0)).count() == 0


def test_exact_dedup_history_and_null_ids(spark):
    old = spark.createDataFrame([(5, "same"), (None, "other")], "doc_id long, text string")
    new = spark.createDataFrame([(2, "sa me"), (7, "same"), (None, "other"), (9, "new")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(new, old).collect()))
    assert got == [(-1, -1, 2, False), (-1, -1, 2, True), (2, 2, 3, True), (5, 2, 3, False), (7, 2, 3, False), (9, 9, 1, True)]


def test_exact_dedup_matches_sql(spark):
    want = connect(H.SF).sql(queries.ORACLE_SQL["op1_exact_dedup"]).df()
    assert rows(queries.op1_exact_dedup(spark, H.SF).toPandas()) == rows(want)


def test_one_row_of_repeated_ids_stays(spark, tmp_path):
    rows = [(1, "aa"), (1, "aa"), (1, "a a"), (2, "aa"), (3, "b"), (3, "c"), (None, "d"), (None, "d"), (4, "b b"), (4, "bb")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit("x"))
    got = exact_dedup.exact_dedup(df).filter("kept").collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"]) for r in got) == [(-1, -1, 4), (1, 1, 8), (3, 3, 2), (3, 3, 2), (4, 4, 4)]
    df.write.parquet(str(tmp_path / "docs"))
    for docs in (df, spark.read.parquet(str(tmp_path / "docs"))):
        out = exact_dedup.survivors(docs)
        assert out.columns == docs.columns
        assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect()) == [(-1, "d"), (1, "a a"), (3, "b"), (3, "c"), (4, "b b")]


def test_survivors_keep_columns(spark):
    docs = H.documents(spark, ["a", "a ", "b"])
    out = exact_dedup.survivors(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}


def test_shingles_are_those_of_words():
    for text in ("", "a b", "A b c d e F", "x  y\tz\nq w e r t", "a b c d e a b c d e a"):
        assert len(shingle_set(np.frombuffer(text.encode(), np.uint8))) == len(H.shingles(text))


def near_copies():
    """Chains around the similarity, a hot group, a shared passage, edge cases."""
    base, rng = H.prose(1, 120), random.Random(2)
    texts = [" ".join(base)]
    for i in range(40):  # copies with 1 to 6 words replaced
        w = list(base)
        for at in rng.sample(range(120), 1 + i % 6):
            w[at] = f"new{i}x{at}"
        texts.append(" ".join(w))
    passage = H.prose(9, 60)
    texts += [" ".join(H.prose(100 + i, 40 + 10 * (i % 8)) + passage) for i in range(40)]
    chain = H.prose(5, 80)
    for i in range(10):
        texts.append(" ".join(chain[i * 3 :] + H.prose(50 + i, i * 3)))
    exact = H.prose(7, 6)  # 10 shingles and 8 of them: exactly 0.8
    texts += [" ".join(exact * 2), " ".join((exact * 2)[:-2]), "A B C D", "a b c d"]
    return texts + H.edge_texts()


def test_join_equals_brute_force(spark):
    texts = near_copies()
    got = ngram_join.jaccard_components(H.documents(spark, texts)).collect()
    want = H.components(texts)
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(H.shingles(t)) for i, t in enumerate(texts)}
    assert len(got) == len(texts)


def test_join_empty_and_null_ids(spark):
    assert ngram_join.jaccard_components(H.documents(spark, ["x"]).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["n_shingles"]) for r in ngram_join.jaccard_components(df).collect())
    assert got == [(-1, -1, 0), (-1, 4, 2), (4, 4, 2), (4, 4, 2)]


def test_one_row_of_each_group_stays(spark, tmp_path):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (4, "A b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "g h i"), (None, "g h i"), (None, "j k"), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit("x"))
    df.write.parquet(str(tmp_path / "docs"))
    for docs in (df, spark.read.parquet(str(tmp_path / "docs"))):
        out = ngram_join.one_of_each(docs)
        assert out.columns == docs.columns
        assert sorted((r["doc_id"] or -1, r["text"].lower()) for r in out.collect()) == [(-1, "g h i"), (-1, "j k"), (4, "a b c d e f"), (7, ""), (7, "")]


def test_join_on_the_table(spark):
    docs = table(spark, H.SF, "documents")
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(by_id)
    want = H.components([by_id[i] for i in ids])
    got = {r["doc_id"]: r["component_id"] for r in queries.op3_ngram_jaccard(spark, H.SF).collect()}
    assert got == {i: ids[w] for i, w in zip(ids, want, strict=True)}


def test_prefixes_hold_for_linked_sets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(1, 2**60, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) > 0.1]
        b = np.unique(np.concatenate([keep, rng.integers(1, 2**60, 2, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 5 * common < 4 * (len(a) + len(b) - common):
            continue
        counts = lambda x: (x % np.uint64(3) == 0) * 9
        for x, y in zip(ngram_join.prefixes(a, counts(a)), ngram_join.prefixes(b, counts(b)), strict=True):
            assert len(np.intersect1d(x, y))


@pytest.mark.parametrize("n", range(1, 30))
def test_prefix_length(n):
    assert ngram_join.prefix_length(n) == n - (4 * n + 4) // 5 + 1
