"""Connected components of a graph by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reached) for the nodes of the edges ``u, v`` (integers).

    Large and small stars alternate until nothing changes; each round's edges
    are written to the shared folder, which cuts the lineage.  Minima are
    combined before the shuffle.  Nodes without edges are not listed.
    """
    now = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = None
    while True:
        # Large star: every larger neighbour is tied to the least neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u") \
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Small star: every node and its smaller neighbours are tied to the least of them.
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v") \
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, cut(small, "stars")
        drop(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
