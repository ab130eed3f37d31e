"""Connected components of an edge table by alternating large and small stars.

Every step is a distributed aggregation and join; nothing but the number of
changed edges comes to the driver. Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.store import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) of all nodes with an edge; component is the least node that can be reached.

    edges has the long columns u and v; loops and doubled edges do no harm, nulls are left out.
    An empty edge table gives an empty result.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    k = 0
    while True:
        k += 1
        after = scratch.keep(_small_star(_large_star(now)), f"{name}-{k}")
        # A forest of stars is its own image: as many edges, and none that differs.
        stable = after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(f"{name}-{k - 1}")
        now = after
        if stable:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
