"""Closed intervals: merging, containment, range joins and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersect(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> tuple[Column, Column]:
    """Both null if empty."""
    lo, hi = F.greatest(lo1, lo2), F.least(hi1, hi2)
    return F.when(lo <= hi, lo), F.when(lo <= hi, hi)


def high_bound(lo: Column, width: Column) -> Column:
    """lo + width - 1, held at the largest 64-bit number."""
    top = F.lit(2**63 - 1)
    return F.when(lo > top - (width - 1), top).otherwise(lo + width - 1)


def strictly_below(hi: Column, point: Column) -> Column:
    """Null where an end is open."""
    return hi < point


def strictly_above(lo: Column, point: Column) -> Column:
    return lo > point


def size(lo: Column, hi: Column) -> Column:
    """Points of a closed interval; null of an empty or open one."""
    return F.when(lo <= hi, hi - lo + 1)


def islands(df: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Disjoint intervals that cover the same points, with n, how many went into each. Equal ends touch, neighbours that are one apart don't."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col(lo) > before), 1).otherwise(0))
    marked = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_i").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n")).drop("_i")


def bounds(df: DataFrame, by: str, width: str) -> DataFrame:
    """Islands of a base's accesses, and the widths that occur."""
    widths = df.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(width)), ",").alias("widths"))
    return islands(df, [by]).join(widths, by)


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, start: str, value: str) -> DataFrame:
    """left with the value of the greatest start at or below its place: one pass over both sides in order, no pairs."""
    rows = left.select("*", F.lit(1).alias("_side"), F.col(at).alias("_at"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"))
    marks = right.select(*[F.col(by) if c == by else F.lit(None).cast(t).alias(c) for c, t in left.dtypes], F.lit(0).alias("_side"), F.col(start).alias("_at"), F.col(value).alias("_v"))
    w = Window.partitionBy(by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(marks).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return out.where("_side = 1").drop("_side", "_at", "_v")


def in_range(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Each point with the half-open ranges it lies in. Both sides meet in bins of the given width, so the join is on equal keys."""
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return p.join(r, "_bin").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def contained(inner: DataFrame, outer: DataFrame, by: str) -> DataFrame:
    """inner (lo, hi) with the outer interval it starts in, and whether it hangs over that one's end. outer: disjoint, as islands() gives."""
    o = outer.select(F.col(by), F.col("lo").alias("outer_lo"), F.col("hi").alias("outer_hi"))
    found = as_of(inner, o.withColumn("_o", F.struct("outer_lo", "outer_hi")), by, "lo", "outer_lo", "_o")
    return found.select(*inner.columns, F.col("_o.outer_lo").alias("outer_lo"), F.col("_o.outer_hi").alias("outer_hi"), (F.col("hi") > F.col("_o.outer_hi")).alias("overhangs"))
