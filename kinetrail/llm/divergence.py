"""How the sources of a language diverge in their terms.

A term is a run of letters: A-Z, a-z and all code points from U+0080 on, A-Z in
lower case. One table for bytes.translate lowers the letters and blanks every
other ASCII byte in one pass; bytes.split cuts the terms and a Counter per
document gives frequencies, which a task sums up per source before anything is
shuffled. All further work is on sparse rows (lang, source, term, count).

Distances between sources are sums over all kept terms of a language. Terms are
dealt into blocks and sources into tiles; a task sets two tiles against each
other over one block, as small matrices, and returns partial sums. A term that
neither source of a pair has adds the same amount for each, which is counted, not
listed.

Defined results: null text, lang and source are empty; documents without terms
still make their group occur; repeated rows count each; a source alone in its
language has no pairs; a language without kept terms gives distances of 0 and no
terms; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, text_of

#: A term is kept where so many documents of the language have it.
LEAST_DOCS = 30
#: Added to every count.
PSEUDO = 5
SCALE = 1_000_000_000
TOP = 50
#: Entries that a task holds before it hands its sums on.
HELD = 200_000
#: Terms of a block and sources of a tile, on average.
BLOCK, TILE = 4096, 32

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(raw: bytes) -> Counter:
    """Terms of a text (UTF-8) and how often each occurs."""
    return Counter(raw.translate(_TABLE).split())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed up over the documents of a task; a
    row without term for the documents of the group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            terms = list(counts)
            for at in range(0, len(terms), 20_000):
                some = terms[at : at + 20_000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang] * len(some), type=pa.string()),
                        "source": pa.array([source] * len(some), type=pa.string()),
                        "term": pa.array([t or None for t in some], type=pa.binary()),
                        "n": pa.array([counts[t] for t in some], type=pa.int64()),
                        "docs": pa.array([docs[t] for t in some], type=pa.int64()),
                    }
                )

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(counts)
            own = term_counts(text.as_buffer().to_pybytes())
            for term, n in own.items():
                counts[term] += n
            docs.update(own.keys())
            counts[b""] += 0
            docs[b""] += 1
            size += len(counts)
            if size >= HELD:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in
    every group, and a row with term null for the group itself."""
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    slim = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), text_of(docs, text_col).cast("binary").alias("text"))
    rows = slim.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def keep_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Rows of count_terms() whose term enough documents of the language have,
    with lang_n (the term's count there) and head (one row of a term has 1)."""
    same = Window.partitionBy("lang", "term")
    rows = counts.filter("term is not null").withColumns(
        {
            "lang_docs": F.sum("docs").over(same),
            "lang_n": F.sum("n").over(same),
            "head": (F.row_number().over(same.orderBy("source")) == 1).cast("int"),
        }
    )
    return rows.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "head")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PSEUDO) / (total + PSEUDO * terms)), exactly; 0
    without terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PSEUDO).cast("decimal(20,0)")
    below = (total + PSEUDO * terms).cast("decimal(20,0)")
    return F.when(terms > 0, 1 + F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(20,0)")))).otherwise(0).cast("long")


def group_totals(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, p0, terms, lang_total, sources) of every group that
    occurs; p0: the share of a term that the group lacks."""
    groups = counts.filter("term is null").select("lang", "source")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.sum("head").alias("terms"), F.sum("n").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(terms, "lang", "left")
    out = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").na.fill(0, ["total", "terms", "lang_total"])
    return out.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))


PARTIAL = "lang string, a string, b string, value long"


def _tile_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Partial distances of the sources of two tiles over one block of terms."""
    lang, left, right, block = key
    heads = rows[rows["term"].isna()]
    entries = rows[rows["term"].notna()]
    at, terms = pd.factorize(entries["term"])
    names, p0 = heads["source"].to_numpy(), heads["p0"].to_numpy(dtype=np.int64)
    place = {name: i for i, name in enumerate(names)}
    shares = np.repeat(p0[:, None], len(terms), axis=1)
    shares[[place[s] for s in entries["source"]], at] = entries["p"].to_numpy(dtype=np.int64)
    tile = heads["tile"].to_numpy()
    # terms that no source here has are counted once per pair, in the first block
    others = (int(heads["terms"].iloc[0]) if block == 0 else 0) - len(terms)
    out: dict[str, list] = {"a": [], "b": [], "value": []}
    for i in np.flatnonzero(tile == left):
        with_ = np.flatnonzero((tile == right) & ((names > names[i]) | (left != right)))
        values = np.abs(shares[with_] - shares[i]).sum(axis=1) + others * np.abs(p0[with_] - p0[i])
        out["a"] += [names[i]] * len(with_)
        out["b"] += list(names[with_])
        out["value"] += values.tolist()
    names_of = {"lang": [lang] * len(out["a"]), "a": out["a"], "b": out["b"]}
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in names_of.items()} | {"value": pd.Series(out["value"], dtype="int64")})


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): distance of every two sources of a language,
    in both directions. kept: keep_terms() with p; groups: group_totals()."""
    sized = groups.withColumns(
        {"tiles": F.ceil(F.col("sources") / TILE).cast("int"), "blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK)).cast("int")}
    )
    sized = sized.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    heads = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    heads = heads.withColumns({"term": F.lit(None).cast("string"), "p": F.lit(None).cast("long")})
    entries = kept.select("lang", "source", "term", "p").join(sized, ["lang", "source"])
    entries = entries.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    rows = heads.unionByName(entries.select(heads.columns))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = other.select(
        "lang", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "block",
        "source", "tile", "p0", "terms", "term", "p",
    )
    partial = dealt.groupBy("lang", "left", "right", "block").applyInPandas(_tile_sums, PARTIAL)
    summed = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", ends.alias("_e"), "value").select("lang", "_e.source", "_e.item", "value")


def telling_terms(kept: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a source has more often than its
    language. kept: keep_terms() with p and q."""
    more = kept.filter((F.col("n") > 0) & (F.col("p") > F.col("q")))
    return more.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank): all distances (part pair) and the
    top terms (part term) of every group; columns: of count_terms()."""
    with bounded_batches(docs.sparkSession):
        counts = materialise(count_terms(docs, **columns), "term-counts")
    kept = materialise(keep_terms(counts, least_docs), "kept-terms")
    groups = materialise(group_totals(counts, kept), "groups")
    facts = groups.select("lang", "source", "total", "terms", "lang_total")
    with_shares = kept.join(facts, ["lang", "source"]).withColumns(
        {
            "p": share(F.col("n"), F.col("total"), F.col("terms")),
            "q": share(F.col("lang_n"), F.col("lang_total"), F.col("terms")),
        }
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = source_distances(with_shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    terms = telling_terms(with_shares).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank)
    return pairs.unionByName(terms.filter(F.col("rank") <= top))
