"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each u's smallest neighbour or itself, joined back to its pairs."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _done(pairs: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then every component is a star around its smallest node."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("top")), F.struct(F.col("v").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("top")))).alias("e")
    nodes = pairs.select(ends).select("e.*").groupBy("node").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    return nodes.where((F.col("low") > 1) | ((F.col("low") > 0) & (F.col("top") > 0))).isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges (a, b): rows (node, component) for each node of an edge; the component is its smallest node.

    A round takes a number of rows in proportion to the edges; the number of rounds grows with
    the logarithm of the longest path. Each round is saved; only whether it was the last comes to
    the driver.
    """
    now, k = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = _star(large.distinct())
        small = down.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        now = scratch.save(small, f"{name}-{k}")
        if k:
            scratch.drop(f"{name}-{k - 1}")
        if _done(now):
            break
        k += 1
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
