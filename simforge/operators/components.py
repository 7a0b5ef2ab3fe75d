"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settled


def components(links: DataFrame) -> DataFrame:
    """item, same: the smallest item that links (a, b) lead to, for every item of a link.

    In turn, the larger neighbours of an item are hung below its smallest neighbour,
    and the smaller ones too: each round shortens all ways, so that their number is
    logarithmic in the longest. Links to itself, repeated ones and null ends don't matter.
    """
    edges = settled(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        both = edges.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        above = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        least = above.groupBy("x").agg(F.min("y").alias("m"))
        below = above.join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).where("hi != lo")
        new = settled(below.unionByName(least.select(F.col("x").alias("hi"), F.col("m").alias("lo"))).distinct())
        same = new.exceptAll(edges).limit(1).count() + edges.exceptAll(new).limit(1).count() == 0
        edges = new
        if same:
            low = edges.select(F.col("lo").alias("item")).distinct()
            return edges.select(F.col("hi").alias("item"), F.col("lo").alias("same")).unionByName(low.select("item", F.col("item").alias("same")))
