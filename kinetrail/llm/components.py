"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(dealt_anew("u"), "m")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, move to the smallest."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.select(dealt_anew("u"), "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; edges (u long, v long) in
    either direction; component is the smallest node.

    The stars keep the number of edges and end when they no longer change; each
    round is a written table.
    """
    now = materialise(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    before, told = None, ()
    while told != before:
        before, now = told, materialise(_small_star(_large_star(now)), "edges")
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    nodes = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
