"""Connected components over an edge table of any size: alternating large and small stars, no driver-side links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: Edges that one task holds whole: so few need no shuffles.
FEW = 1 << 14


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node that it reaches) of every node with an edge; an empty edge table gives none.

    Each round points every node's larger neighbours, then its smaller ones, to the smallest of them, till all trees
    are stars. Minima are pre-aggregated before their shuffle and go back to the edges by a join that Spark can split;
    either half of a round is a table of its own, so no join is made twice. FEW edges or less go through one task.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("v <> u").distinct()
    e = old = cut(e, "edges")
    few, seen = e.count() <= FEW, None
    while True:
        # large star: for each node, its larger neighbours go to the smallest of all neighbours and itself
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        both = both.coalesce(1) if few else both
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = cut(both.filter("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct(), "stars")
        # small star: smaller neighbours and the node itself go to the smallest of them
        stars = large.coalesce(1) if few else large
        least = stars.groupBy("v").agg(F.min("u").alias("m"))
        ends = F.explode(F.array("u", "v"))
        e = stars.join(least, "v").select(ends.alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        before, e = old, cut(e, "edges")
        release(before, large)
        old = e
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).collect()[0]
        if state == seen:
            return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
        seen = state
