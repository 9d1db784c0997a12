"""Connected components by alternating star contraction, with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _smallest(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, itself included. Partial sums come before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = _smallest(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node``, ``root`` (least node reachable) for every node with an edge ``u``-``v``.

    Loops and repeated edges are allowed. A round halves long chains at least,
    so the number of rounds is logarithmic; a hub is only a key of a join that
    adaptive execution splits. No edge list reaches the driver.
    """
    now = scratch.keep(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct())
    while True:
        after = scratch.keep(_small_star(_large_star(now)))
        scratch.drop(now)
        now = after
        # Done when every node points to one root and no root points on.
        per_node = now.groupBy("u").agg(F.count("*").alias("n"))
        if now.join(per_node.where("n > 1"), "u", "left_semi").union(now.join(per_node.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v")).isEmpty():
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
