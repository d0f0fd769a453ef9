"""Connected components of an edge table, by alternating stars.

Every step is a join-free aggregation and a join on the nodes, written to the shared folder; it ends when every node has
one neighbour, which is no other's neighbour's neighbour.  Nothing but whether that is so comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_STEPS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours linked to its least neighbour: the larger ones, or the others and itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges, from larger to smaller nodes, are stars with their least nodes in the middle."""
    of_node = edges.select("u", F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")).distinct())
    return of_node.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or (ups = 1 and low = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); the root is the component's least node."""
    scratch = Scratch(edges.sparkSession)
    larger, smaller = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = scratch.stored(edges.where("u != v").select(larger, smaller).distinct(), "edges")
    for step in range(MAX_STEPS):
        if _settled(now):
            break
        now = scratch.stored(_star(_star(now, large=True), large=False), f"edges-{step}")
        scratch.release(f"edges-{step}")
    else:
        raise RuntimeError("the components did not settle")
    pairs = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = pairs.select(F.col("root").alias("node"), "root").distinct()
    return pairs.unionByName(roots)


