"""Connected components of an edge table, by alternating large and small stars.

Every round rewires edges towards the smallest id of a neighbourhood until each
component is a star; the number of rounds grows with the logarithm of the longest
path.  All work is joins and grouped minima, so a hub with any number of edges is
combined before the shuffle or split by the adaptive skew join, and nothing but a
count and a checksum reaches the driver.  Each round is cut to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    """For each node, its larger neighbours are tied to the least of the neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """For each node, its smaller neighbours and itself are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ties = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return ties.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node of edges (a, b) with a <> b; comp is the least id reachable."""
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    mark = _mark(now)
    while mark[0]:
        then = cut(_small_star(_large_star(now)))
        new = _mark(then)
        drop(now)
        now = then
        if new == mark:
            break
        mark = new
    nodes = now.select(F.col("b").alias("id"), F.col("a").alias("comp"))
    return nodes.unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("comp"))).groupBy("id").agg(F.min("comp").alias("comp"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())
