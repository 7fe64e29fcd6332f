"""Scans along a session that many tasks share.

Rows of a key are cut into blocks by their order, and each block is worked off by
its own task. What a row needs to know of earlier blocks is carried over:

* `stitched_runs`, `with_position`, `running_sum`: each block gives a summary (rows,
  sum, first and last value, the runs at its two ends), sums over the summaries
  of a key carry state from block to block, and a join hands it to the rows. The
  table of summaries is smaller than the rows by the size of a block.
* `in_blocks`: for chains of windows that reach a bounded number of rows. A block
  comes with so many rows of its neighbours, which are dropped afterwards.

Blocks are dealt out by an exchange of their own: rows that an earlier step has
dealt out by the key alone would pass for dealt out well enough, and a hot key
would stay in one task.

The order is a whole number that no two rows of a key share; rows without a key or
a place take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Order values in a block: rows of a block at most.
BLOCK = 1 << 18
#: Order values that in_blocks() counts together.
BUCKET = 1 << 10
#: Rows of a table of block bounds up to which it is broadcast (some 50 MB).
BROADCAST_ROWS = 1_000_000

Apply = Callable[[DataFrame, Sequence[str]], DataFrame]


def _block(order: str, size: int) -> Column:
    return F.expr(f"{order} div {size}")


def _in_order(df: DataFrame, keys: Sequence[str], order: str, size: int) -> DataFrame:
    """df with _block, dealt out by it. What a later join would ask for, a key and
    a place, is asked for here: so all passes read one exchange."""
    cut = df.withColumn("_block", _block(order, size))
    for name in (*keys, "_block"):
        cut = cut.filter(F.col(name).isNotNull())
    return cut.repartition(*keys, "_block")


def stitched_runs(
    df: DataFrame, value: Column, differs: Callable[[Column, Column], Column], keys: Sequence[str], order: str = "frame",
    block: int | None = None, most: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(keys, start, end, low, high): runs of rows, in row positions from 0, with
    the least and the greatest value of each, and the greatest of each column of
    most.

    differs(before, value): does a row with value open a new run after a row with
    before? Within a run, values must be equal or grow.

    Runs are found per block. Those at the end of a block and the beginning of the
    next one get a common number where they belong together; an inner run is
    final. The runs, which are far fewer than the rows and mostly read more than once,
    become a table.
    """
    return written(_runs(df, value, differs, keys, order, block or BLOCK, most), "runs")


def _runs(
    df: DataFrame, value: Column, differs: Callable[[Column, Column], Column], keys: Sequence[str], order: str, block: int, most: Mapping[str, Column] | None = None
) -> DataFrame:
    """The plan of stitched_runs(): both passes read one exchange of (keys, order,
    value)."""
    keys, most = list(keys), most or {}
    greatest = [F.max(c).alias(c) for c in most]
    rows = df.select(*keys, F.col(order).alias("_o"), value.alias("_v"), *(c.alias(n) for n, c in most.items()))
    rows = _in_order(rows, keys, "_o", block)
    w = Window.partitionBy(*keys, "_block").orderBy("_o")
    opens = F.coalesce(differs(F.lag("_v").over(w), F.col("_v")).cast("int"), F.lit(0))
    rows = rows.withColumns({"_new": opens, "_pos": (F.row_number().over(w) - 1).cast("long")})
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = rows.groupBy(*keys, "_block", "_run").agg(
        F.min("_pos").alias("_start"), F.max("_pos").alias("_end"), F.min("_v").alias("low"), F.max("_v").alias("high"), *greatest
    )
    blocks = pieces.groupBy(*keys, "_block").agg(
        (F.max("_end") + 1).alias("_rows"), F.max("_run").alias("_last"), F.min_by("low", "_run").alias("_first_v"), F.max_by("high", "_run").alias("_last_v")
    )
    line = Window.partitionBy(*keys).orderBy("_block")
    before, so_far = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumns(
        {
            "_offset": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
            "_fresh": F.coalesce(differs(F.lag("_last_v").over(line), F.col("_first_v")), F.lit(True)).cast("int"),
            "_more": (F.col("_last") > 0).cast("int"),
        }
    )
    left = F.sum("_fresh").over(so_far) + F.coalesce(F.sum("_more").over(before), F.lit(0))
    carry = blocks.select(*keys, "_block", "_offset", "_last", left.alias("_left"), (left + F.col("_more")).alias("_right"))
    # a run that touches an end of its block has a number of the key, another one its own
    at_end = F.when(F.col("_run") == 0, F.col("_left")).when(F.col("_run") == F.col("_last"), F.col("_right"))
    joined = pieces.join(carry, [*keys, "_block"]).withColumns(
        {
            "_g": F.when(at_end.isNotNull(), F.lit(None)).otherwise(F.col("_block")), "_n": F.coalesce(at_end, F.col("_run")),
            "_start": F.col("_start") + F.col("_offset"), "_end": F.col("_end") + F.col("_offset"),
        }
    )
    found = joined.groupBy(*keys, "_g", "_n").agg(
        F.min("_start").alias("start"), F.max("_end").alias("end"), F.min("low").alias("low"), F.max("high").alias("high"), *greatest
    )
    return found.drop("_g", "_n")


def flag_runs(
    df: DataFrame, flag: str | Column, keys: Sequence[str], order: str = "frame", block: int | None = None, most: Mapping[str, Column] | None = None
) -> DataFrame:
    """(keys, start, end, flag): runs of equal flags in row positions; null is false.
    With the greatest value in the run of each column of most."""
    value = F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))
    found = stitched_runs(df, value, lambda a, b: a != b, keys, order, block, most)
    return found.select(*keys, "start", "end", F.col("low").alias("flag"), *(most or {}))


def _carried(df: DataFrame, keys: Sequence[str], order: str, size: int, amount: Column) -> DataFrame:
    """df with _block and _carry, the sum of amount over earlier blocks."""
    cut = _in_order(df, keys, order, size)
    sums = cut.groupBy(*keys, "_block").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_block", F.sum("_sum").over(before).alias("_carry"))
    return cut.join(carry, [*keys, "_block"])


def with_position(df: DataFrame, keys: Sequence[str], order: str = "frame", name: str = "pos", block: int | None = None) -> DataFrame:
    """Adds the row's position in its key, from 0. df is read twice, for the
    counts by its keys and order alone."""
    cut = _carried(df, keys, order, block or BLOCK, F.lit(1).cast("long"))
    own = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)) - 1
    return cut.withColumn(name, (own + F.coalesce("_carry", F.lit(0))).cast("long")).select(*(df[c] for c in df.columns if c != name), name)


def running_sum(df: DataFrame, value: Column, keys: Sequence[str], out: str, order: str = "frame", block: int | None = None) -> DataFrame:
    """Adds the sum of value up to the row. df is read twice: hand in a table."""
    cut = _carried(df.withColumn("_value", value), keys, order, block or BLOCK, F.col("_value"))
    own = F.sum("_value").over(Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn(out, own + F.coalesce("_carry", F.lit(0))).drop("_block", "_carry", "_value")


def _bounds(df: DataFrame, keys: Sequence[str], order: str, reach: int, rows: int) -> DataFrame | None:
    """(keys, _bucket, _blocks) of keys with more than rows rows: the blocks that
    need a bucket, and whether it is their own. None without such keys."""
    # keys are counted before their order is looked at: mostly none is that long
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).select(*keys)
    if long.isEmpty():
        return None
    counts = df.join(long, keys, "left_semi").groupBy(*keys, _block(order, BUCKET).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy(*keys).orderBy("_bucket")
    before = F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumns({"_before": before, "_total": F.sum("_n").over(Window.partitionBy(*keys))}).filter(F.col("_total") > rows)
    placed = placed.withColumn("_block", F.expr(f"_before div {rows}"))
    own = Window.partitionBy(*keys, "_block")
    placed = placed.withColumns({"_first": F.min("_before").over(own), "_last": F.max(F.col("_before") + F.col("_n")).over(own)})
    part = lambda number, mine, when: F.when(when, F.struct(number.alias("block"), F.lit(mine).alias("own")))
    block = F.col("_block")
    parts = F.array(
        part(block, True, F.lit(True)),
        part(block - 1, False, F.col("_before") - F.col("_first") < reach),
        part(block + 1, False, F.col("_last") - F.col("_before") - F.col("_n") < reach),
    )
    return placed.select(*keys, "_bucket", F.array_compact(parts).alias("_blocks"))


def in_blocks(df: DataFrame, keys: Sequence[str], reach: int, apply: Apply, order: str = "frame", rows: int | None = None) -> DataFrame:
    """apply(df, keys and block) without needing a key in one task.

    apply: a chain of windows over the keys that it is given, in the given order,
    that look reach rows back or ahead at most and keep the columns they get. Keys
    of more than rows rows are cut into blocks, each with reach rows of its
    neighbours; which keys these are is counted first, on the keys alone. A
    key of fewer rows is one block. The cut goes by counted rows, so that holes in
    the order do no harm.
    """
    rows, keys = rows or BLOCK, list(keys)
    if reach + BUCKET > rows // 2:
        raise ValueError("a block must be larger than twice its reach")
    bounds = _bounds(df, keys, order, reach, rows)
    few = bounds.limit(BROADCAST_ROWS + 1).count() if bounds is not None else 0
    whole = F.struct(F.lit(0).cast("long").alias("block"), F.lit(True).alias("own"))
    if few:
        bounds = F.broadcast(bounds) if few <= BROADCAST_ROWS else bounds
        joined = df.withColumn("_bucket", _block(order, BUCKET)).join(bounds, [*keys, "_bucket"], "left")
        cut = joined.withColumn("_part", F.explode(F.coalesce("_blocks", F.array(whole))))
    else:
        cut = df.withColumn("_part", whole)
    cut = cut.select(*df.columns, F.col("_part.block").alias("_block"), F.col("_part.own").alias("_own"))
    cut = cut.repartition(*keys, "_block") if few else cut
    return apply(cut, [*keys, "_block"]).filter("_own").drop("_block", "_own")
