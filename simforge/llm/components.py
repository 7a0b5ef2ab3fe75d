"""Connected components over tables of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component_id (the smallest node reachable) for every node of a link.

    Each round hangs nodes below smaller neighbours, so the depth of a component
    shrinks by a factor and the number of rounds is logarithmic; links and labels
    stay in tables. Self links and repeated links don't matter.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links")
    while True:
        # Large star: every larger neighbour of u is linked to the smallest neighbour of u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "links")
        changed = new.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(new, ["u", "v"], "left_anti").limit(1).count()
        edges = new
        if not changed:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
