"""Fixtures and plain versions that the tests compare with."""

from __future__ import annotations

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, extra=True):
    """A documents table with a clashing extra column."""
    rows = [
        (i, t, "en", sources[i] if sources else f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("digest", "token", "part", "kept", "size", "block", "_source"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def prose(seed: int, words: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]


def edge_texts() -> list[str | None]:
    return [None, "", " \t\n ", "one", "one", "a b c d", "a b c d e", "x" * 200_000, "Ünïcödé 😀 text", "a b c d", "<|endoftext|>"]


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def components(texts) -> list[int]:
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return [find(i) for i in range(len(sets))]
