"""Connected components of a graph whose edges don't fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpoint


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component of the nodes of edges(u, v): component is the smallest node that can be reached.

    Alternates the large-star and small-star steps until the edges are stars around the smallest nodes. Each
    step takes minima by an aggregation that combines before the shuffle and hands them out by a join that Spark
    can split, so a node with very many neighbours is no hot task. Rounds grow with the logarithm of the longest path.
    Edges from a node to itself and null ends are left out; a graph without edges gives an empty result.
    """
    now = checkpoint(edges.select(F.col("u").alias("u"), F.col("v").alias("v")).filter("u is not null and v is not null and u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = checkpoint(small)
    raise RuntimeError(f"the components aren't found after {most_rounds} rounds")
