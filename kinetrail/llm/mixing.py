"""Mixing sources to target weights with a multivariate-hypergeometric tree.

A source's documents are dealt into blocks by a keyed hash; the mix takes whole
blocks in a permuted order, each at most MAX_PASSES times, until the source's
target is reached, and opens only the last one to come closer. The number of
blocks of each source is its quota. A binary tree of multivariate hypergeometric
draws, each keyed by the tree's node, splits the quotas exactly among the output
shards, so that a shard gets its counts from the path to it alone; prefix sums
over the shards turn the counts into disjoint ranges of the permuted blocks, and
every shard is shuffled locally by a keyed hash. A document's taken counts the
times that the shards draw its row.

Defined results: null text has size 0; a null source is one source, last in
order; documents of size 0 are never taken; repeated rows are sized and taken as
separate documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, text_of, with_row_id

WEIGHTS = (5.0, 2.0, 1.0)
VOLUME = 1.5
MAX_PASSES = 2
DOCS_PER_BLOCK = 128
#: Turns of a source that one task puts in order, about.
TURNS_PER_TASK = 50_000
DOCS_PER_SHARD = 8_192
#: Rows of the block plan that are broadcast (one for each block and pass); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SEED = 20_240_611


def word_count(text: Column) -> Column:
    """Number of words of a non-null text."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, volume: float = VOLUME, cap: float = MAX_PASSES
) -> DataFrame:
    """(source, weight, source_size, target) from (source, source_size).

    Targets are w_i * level, capped at cap * source_size; the level that uses up
    the whole volume follows in one sort by the level at which a source is full
    (its cap over its weight), with running sums of caps and weights: the fixed
    point of resharing the excess by weight. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ).withColumn("full_at", F.lit(cap) * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = before.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.withColumn(
        "level",
        (
            F.lit(volume) * F.sum("source_size").over(everything)
            - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0))
        )
        / F.sum("weight").over(rest),
    )
    # the level if this source and all fuller ones stay below their caps; the first such source fixes it
    level = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(
        F.col("level") <= F.col("full_at"), F.col("full_at"))).over(everything)
    capped = F.lit(cap) * F.col("source_size").cast("double")
    return levels.select(
        "source", "weight", "source_size", F.least(capped, F.coalesce(F.col("weight") * level, capped)).alias("target")
    )


def split_counts(counts: np.ndarray, shard: int, shards: int, seed: int) -> np.ndarray:
    """How many blocks of each source shard gets: a walk from the tree's root.

    A node over shards [low, high) holds a count per source; its left half draws
    a multivariate hypergeometric sample from it, keyed by the node, the right
    half gets the rest. The leaves of the tree sum to counts exactly.
    """
    low, high, node = 0, shards, 1
    while high - low > 1:
        middle = (low + high) // 2
        total = int(counts.sum())
        take = total * (middle - low) // (high - low)
        rng = np.random.Generator(np.random.Philox(key=[seed, node]))
        left, rest, need = np.zeros_like(counts), total, take
        for i, n in enumerate(counts):  # one univariate draw per source given what remains
            rest -= int(n)
            got = int(rng.hypergeometric(int(n), rest, need)) if need and n else 0
            left[i], need = got, need - got
        if shard < middle:
            counts, high, node = left, middle, 2 * node
        else:
            counts, low, node = counts - left, middle, 2 * node + 1
    return counts


def _greedy(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a block, the documents that come closest under what is missing."""
    frame = frame.sort_values(["size", "order", "uid"], ascending=[False, True, True], kind="stable")
    missing, taken = float(frame["missing"].iloc[0]), []
    for size in frame["size"]:
        fits = 0 < size <= missing
        taken.append(fits)
        missing -= size * fits
    frame["fits"] = taken
    return frame[["uid", "order", "fits"]]


class Plan(NamedTuple):
    """rows: docs with _uid; placed: a row per document with its block; blocks:
    those that the mix takes, in their turns; sources: (_source, blocks); fits:
    the documents that it takes of opened blocks."""

    rows: DataFrame
    placed: DataFrame
    blocks: DataFrame
    sources: DataFrame
    fits: DataFrame


def document_key(doc_id: Column, source: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id.cast("long"), source.cast("string"))


def block_of(order: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(order, F.lit(1)), blocks)


def in_turns(passes: DataFrame, blocks: int, seed: int) -> DataFrame:
    """passes (source, block, pass, words, ..) with turn, the place in the permuted
    order of its source, and before, the words of all earlier turns.

    The order is a hash, so that ranges of it are even: each range is ordered in
    a task, after the totals of the ranges before it.
    """
    ranges = max(1, -(-blocks // TURNS_PER_TASK))
    order = F.xxhash64(F.lit(seed), "block", "pass")
    passes = passes.withColumn("_order", order).withColumn(
        "_range", F.shiftright((F.shiftright("_order", 40) + F.lit(1 << 23)) * F.lit(ranges), 24)
    )
    totals = passes.groupBy("source", "pass", "_range").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    earlier = Window.partitionBy("source").orderBy("pass", "_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("source").alias("_s"), F.col("pass").alias("_p"), F.col("_range").alias("_r"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_turns"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("_words"),
    )
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_p")) & (F.col("_range") == F.col("_r"))
    within = Window.partitionBy("source", "pass", "_range").orderBy("_order", "block")
    return (
        passes.join(bases, same)
        .withColumn("turn", F.col("_turns") + F.row_number().over(within))
        .withColumn("before", F.col("_words") + F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .drop("_order", "_range", "_s", "_p", "_r", "_turns", "_words")
    )


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
    weights: tuple[float, ...] = WEIGHTS,
    volume: float = VOLUME,
) -> Plan:
    """The plan of the mix."""
    rows = with_row_id(docs)
    sized = rows.select(
        rows[id_col].cast("long").alias("doc_id"),
        rows[source_col].cast("string").alias("source"),
        word_count(text_of(rows, text_col)).alias("size"),
        document_key(rows[id_col], rows[source_col], seed).alias("order"),
        rows["_uid"].alias("uid"),
    )
    sized = materialise(sized, "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    per_source = materialise(per_source, "mix-sources")
    targets = source_targets(per_source.drop("docs"), weights, volume)
    facts = materialise(
        targets.join(
            per_source.select(F.col("source").alias("_s"), F.ceil(F.col("docs") / DOCS_PER_BLOCK).alias("blocks")),
            F.col("source").eqNullSafe(F.col("_s")),
        ).drop("_s"),
        "mix-targets",
    ).withColumnRenamed("source", "_source")
    # one row per source on the right
    placed = sized.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("block", block_of(F.col("order"), F.col("blocks")))
    placed = materialise(placed, "mix-placed")

    blocks = placed.groupBy("source", "block").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"), F.first("target").alias("target")
    )
    passes = blocks.withColumn("pass", F.explode(F.array([F.lit(i) for i in range(MAX_PASSES)])))
    most = facts.agg(F.max("blocks")).first()[0] or 0
    passes = in_turns(passes, most, seed).filter(F.col("before") < F.col("target"))
    passes = passes.withColumn("whole", F.col("before") + F.col("words") <= F.col("target"))
    passes = materialise(passes, "mix-blocks")

    # a source has one opened block at most, of some DOCS_PER_BLOCK documents
    opened = passes.filter("not whole").select(
        F.col("source").alias("_source"), F.col("block").alias("_block"), (F.col("target") - F.col("before")).alias("missing")
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    fits = (
        placed.join(opened, same)
        .select("uid", "size", "order", "missing", "source")
        .groupBy("source")
        .applyInPandas(_greedy, "uid long, order long, fits boolean")
        .filter("fits")
    )
    fits = materialise(fits.select("uid", "order"), "mix-fits")
    return Plan(rows, placed, passes.select("source", "block", "pass", "turn", "docs", "whole"), facts.select("_source", "blocks"), fits)


def shard_plan(blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, block, pass, whole, shard): the blocks dealt to output shards.

    The tree works on one count per source; every shard walks it by itself in a
    task, and a source's turns fall into the shards' ranges by prefix sums.
    """
    spark = blocks.sparkSession
    counts = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"), F.sum("docs").alias("docs"))
    quotas = counts.orderBy(F.col("source").asc_nulls_last()).collect()  # one row per source
    names, numbers = [r["source"] for r in quotas], np.array([r["blocks"] for r in quotas], dtype=np.int64)
    total = int(numbers.sum())
    shards = max(1, min(total, -(-sum(r["docs"] for r in quotas) // DOCS_PER_SHARD)))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"] if names else ():
                got = split_counts(numbers, int(shard), shards, seed)
                yield pd.DataFrame({"k": range(len(names)), "source": names, "shard": int(shard), "n": got})

    leaves = spark.range(shards).mapInPandas(walk, "k int, source string, shard long, n long")
    ends = F.sum("n").over(Window.partitionBy("k").orderBy("shard"))
    ranges = leaves.withColumn("last", ends).filter("n > 0").select(
        F.col("source").alias("_source"), "shard", F.explode(F.sequence(F.col("last") - F.col("n") + 1, "last")).alias("_turn")
    )
    return blocks.join(
        ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("turn") == F.col("_turn"))
    ).select("source", "block", "pass", "whole", "shard")


def _broadcast(written: DataFrame) -> DataFrame:
    """A written table, broadcast up to BROADCAST_ROWS."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def draw(rows: DataFrame, plan: Plan, seed: int = SEED) -> DataFrame:
    """rows, once for each time that a shard draws them, with _pass and _shard.

    rows have words, _uid, _order, _own (their source) and _block.
    """
    dealt = materialise(shard_plan(plan.blocks, seed), "mix-shards").select(
        *(F.col(c).alias(f"_{c}") for c in ("pass", "whole", "shard")), F.col("block").alias("_of_block"), F.col("source").alias("_of")
    )
    # the order beside the uid: two hashes, so that no two rows are one
    fits = plan.fits.select(F.col("uid").alias("_fit"), F.col("order").alias("_fit_order"), F.lit(True).alias("_fits"))
    drawn = rows.join(_broadcast(dealt), F.col("_own").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_of_block")))
    drawn = drawn.join(_broadcast(fits), (F.col("_uid") == F.col("_fit")) & (F.col("_order") == F.col("_fit_order")) & ~F.col("_whole"), "left")
    return drawn.filter(F.col("_whole") | F.coalesce("_fits", F.lit(False)))


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    plan = plan_mix(docs, seed=seed, **options)
    rows = plan.placed.filter("size > 0").select(
        F.col("uid").alias("_uid"), F.col("order").alias("_order"), F.col("source").alias("_own"), F.col("block").alias("_block")
    )
    times = draw(rows, plan, seed).groupBy("_uid", "_order").agg(F.count(F.lit(1)).alias("_times"))
    counted = plan.placed.join(times, (F.col("uid") == F.col("_uid")) & (F.col("order") == F.col("_order")), "left")
    taken = F.col("size") * F.coalesce("_times", F.lit(0))
    return counted.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: the columns of docs, a row for each time that a document
    is taken, written in shard order and shuffled within each shard."""
    plan = plan_mix(docs, seed=seed, **options)
    id_col, text_col, source_col = (options.get(c, d) for c, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    # a block stands for DOCS_PER_BLOCK documents: texts stay where they are until they go to their shard
    own = plan.rows
    sources = plan.sources.select(F.col("_source").alias("_own"), F.col("blocks").alias("_blocks"))
    rows = own.withColumn("_order", document_key(own[id_col], own[source_col], seed)).join(
        _broadcast(sources), own[source_col].cast("string").eqNullSafe(F.col("_own"))
    )
    rows = rows.filter(F.trim(text_of(own, text_col), F.lit(" \t\n\x0b\f\r")) != "")
    mixed = draw(rows.withColumn("_block", block_of(F.col("_order"), F.col("_blocks"))), plan, seed)
    shuffled = mixed.repartition("_shard").sortWithinPartitions("_shard", F.xxhash64(F.lit(seed), "_order", "_pass"), "_uid")
    return shuffled.select([own[c] for c in docs.columns])
