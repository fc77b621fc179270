"""Connected components of links between long ids, by alternating star contraction.

Every step is a group-and-join on tables in the shared folder; hot nodes are reduced to their smallest
neighbour before the join.  The number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, keep: Scratch, name: str) -> DataFrame:
    """``links(u, v)`` to (node, component): the smallest node of its component, for nodes other than that."""
    edges = keep.keep(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), f"{name}0")
    step = 0
    while True:
        step += 1
        # each half step is written: the next one reads it twice
        half = keep.keep(_large_star(edges), f"{name}{step}a")
        edges = keep.keep(_small_star(half), f"{name}{step}b")
        keep.drop(f"{name}{step}a")
        if step > 1:
            keep.drop(f"{name}{step - 1}b")
        # done when every node has one edge, to a node that has none
        if not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() and not edges.groupBy("u").count().where("count > 1").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
