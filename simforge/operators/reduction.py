"""Buckets of equivalent items, reduced in levels over partitions, and the memo of verdicts on pairs.

An equivalence that is a Python test can't be a key to group by. Items of a group
are spread over slots; each slot finds buckets by itself, and levels merge what
they stand for, one representative a bucket, `fan` slots at a time. So no call
sees a whole group, unless none of its items are equivalent. Buckets are those of
holding every item against every bucket, provided the test is transitive.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import by_key, settled, unsettle


def reduced_buckets(items: DataFrame, same: Callable, slots: int | None = None, fan: int = 4) -> DataFrame:
    """grp, first, item, value: items (grp, item, value), all numbers, in buckets of values that same(a, b) calls equal, each named by its smallest item.

    Items with a null group, item or value are in no bucket; an item that stands
    there several times is in its bucket once. slots: how many parts a group is
    spread over, by default the shuffle partitions.
    """
    spark = items.sparkSession
    slots = slots or int(spark.conf.get("spark.sql.shuffle.partitions"))
    types = {"grp": pa.int64(), "item": pa.int64(), "value": pa.int64(), "rep": pa.int64(), "rep_value": pa.int64(), "slot": pa.int64()}

    def run(key, rows: list[tuple]) -> list[tuple]:
        firsts: list[tuple] = []
        out = []
        for _, grp, item, value, slot in rows:
            rep = next((f for f in firsts if same(f[1], value)), None)
            if rep is None:
                rep = item, value
                firsts.append(rep)
            out.append((grp, item, value, *rep, slot))
        return out

    def level(rows: DataFrame) -> DataFrame:
        keyed = rows.select(F.concat_ws("/", F.col("grp").cast("string"), F.col("slot").cast("string")).alias("key"), "grp", "item", "value", "slot")
        return settled(by_key(keyed, ["item"], run, ", ".join(f"{c} long" for c in types), types))

    long = [F.col(c).cast("long").alias(c) for c in ("grp", "item", "value")]
    rows = items.select(*long).where("grp is not null and item is not null and value is not null").dropDuplicates(["grp", "item"])
    found = [level(rows.withColumn("slot", F.pmod(F.xxhash64("item"), F.lit(slots))))]
    while slots > 1:
        slots = -(-slots // fan)
        reps = found[-1].select("grp", F.col("rep").alias("item"), F.col("rep_value").alias("value"), F.expr(f"slot div {fan}").alias("slot")).distinct()
        found.append(level(reps))
    # From the last level down, what stands for a representative stands for all it stood for.
    to = found[-1].select("grp", "item", F.col("rep").alias("top"))
    for lower in reversed(found[:-1]):
        to = lower.select("grp", "item", "rep").join(to.withColumnRenamed("item", "rep"), ["grp", "rep"]).select("grp", "item", "top")
    names = to.groupBy("grp", "top").agg(F.min("item").alias("first"))
    out = settled(to.join(names, ["grp", "top"]).join(found[0].select("grp", "item", "value"), ["grp", "item"]).select("grp", "first", "item", "value"))
    unsettle(*found)
    return out


def verdict_memo(asked: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, l, r, verdict, n_asked, n_hits, error: one row for each unordered pair of asked (keys, l, r, verdict).

    The first question about a pair is answered by a test and remembered; others are
    hits, in either order. A pair that came with two verdicts was put in twice: its
    verdict is null and error says so. Pairs with a null end are left out.
    """
    pair = asked.where("l is not null and r is not null").select(*keys, F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"), "verdict")
    each = pair.groupBy(*keys, "l", "r").agg(F.count("*").alias("n_asked"), F.min("verdict").alias("_lo"), F.max("verdict").alias("_hi"))
    twice = ~F.col("_lo").eqNullSafe(F.col("_hi"))
    return each.select(*keys, "l", "r", F.when(~twice, F.col("_lo")).alias("verdict"), "n_asked", (F.col("n_asked") - 1).alias("n_hits"), F.when(twice, F.lit("put in twice")).alias("error"))


def hit_rate(memo: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, n_asked, n_hits, rate."""
    sums = memo.groupBy(*keys).agg(F.sum("n_asked").alias("n_asked"), F.sum("n_hits").alias("n_hits"))
    return sums.withColumn("rate", F.round(F.col("n_hits") / F.col("n_asked"), 6))
