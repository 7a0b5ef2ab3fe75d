"""Dataflow with a user's lattice, and path bounds, as rounds of joins over the edges of all graphs at once.

A vertex's value is the join of what comes to it. Values only grow, so a round
takes the vertices that the last one changed, sends what they pass on along their
edges, joins it with what is known where it arrives, and keeps what is new. The
join of all values that a vertex ever had is its last one, so what is known is
never rewritten, only added to. A graph is finished when none of its vertices
changes; the graph that takes longest bounds the rounds.

Edges with a null graph or end pass nothing on, a vertex to which nothing comes
has no row, and an empty table gives an empty one. Columns that begin with an
underscore are the operators' own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import _types, by_size, reached, vertices
from .tables import Grown, by_key, fixpoint, settled, unsettle


@dataclass(frozen=True)
class Lattice:
    """join: an aggregate, the least value above those of a group. passed: what goes on along an edge, of the value where it comes from and the edge's columns; null passes nothing. widened, of the known and the new value: a value above both, taken from round `after` on, which ends chains that would grow for ever."""

    join: Callable[[Column], Column]
    passed: Callable[[Column], Column] = lambda value: value
    widened: Callable[[Column, Column], Column] | None = None
    after: int = 0


def flow(edges: DataFrame, start: DataFrame, lattice: Lattice, backward: bool = False) -> DataFrame:
    """graph, v, value: the least values above start (graph, v, value) that agree with every edge (graph, src, dst and any columns that passed reads)."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    e = edges.where("graph is not null and src is not null and dst is not null").withColumns({"v": F.col(a), "_to": F.col(b)}).drop("src", "dst")
    join = lattice.join(F.col("value")).alias("value")
    first = start.select("graph", "v", "value").where("graph is not null and v is not null and value is not null").groupBy("graph", "v").agg(join)
    old = F.when(F.col("_old"), F.col("value"))
    grown, k = Grown(first), 0
    while True:
        k += 1
        come = grown.last().join(e, ["graph", "v"]).select("graph", F.col("_to").alias("v"), lattice.passed(F.col("value")).alias("value")).where("value is not null")
        # What is known and what has come are joined in one aggregate, beside the join of what was known alone.
        both = grown.all().withColumn("_old", F.lit(True)).unionByName(come.withColumn("_old", F.lit(False)))
        new = both.groupBy("graph", "v").agg(join, F.when(F.bool_or("_old"), lattice.join(old)).alias("_was"), F.bool_and("_old").alias("_still"))
        new = new.where(~F.col("_still") & ~F.col("value").eqNullSafe(F.col("_was")))
        if lattice.widened is not None and k > lattice.after:
            new = new.withColumn("value", F.when(F.col("_was").isNull(), F.col("value")).otherwise(lattice.widened(F.col("_was"), F.col("value"))))
        if not grown.add(new.select("graph", "v", "value")):
            break
    out = settled(grown.all().groupBy("graph", "v").agg(join))
    unsettle(*grown.rounds)
    return out


# Lattices


def any_of() -> Lattice:
    """Whether something holds on some way."""
    return Lattice(F.bool_or)


def flat(step: Column) -> Lattice:
    """One number, or none (top) where ways disagree. An edge adds `step` to it; a null step isn't known. Values are structs known, top; start them with `exactly`."""

    def join(x: Column) -> Column:
        lost = F.bool_or(x["top"]) | F.coalesce(F.min(x["known"]) != F.max(x["known"]), F.lit(False))
        return F.struct(F.when(~lost, F.min(x["known"])).alias("known"), lost.alias("top"))

    def passed(x: Column) -> Column:
        to = x["known"] + step
        return F.struct(to.alias("known"), to.isNull().alias("top"))

    return Lattice(join, passed)


def exactly(value: Column) -> Column:
    return F.struct(value.cast("long").alias("known"), value.isNull().alias("top"))


#: Ends of intervals that are open.
LEAST, MOST = -(2**62), 2**62


def ranges(low: Column, high: Column, after: int = 8) -> Lattice:
    """From the least to the greatest number; an edge adds what lies between low and high. An end that still moves after `after` rounds is open (LEAST, MOST). Values are structs lo, hi; start them with `between`."""

    def passed(x: Column) -> Column:
        lo, hi = x["lo"] + F.coalesce(low, F.lit(LEAST)), x["hi"] + F.coalesce(high, F.lit(MOST))
        lo, hi = F.when((x["lo"] <= LEAST) | low.isNull(), LEAST).otherwise(lo), F.when((x["hi"] >= MOST) | high.isNull(), MOST).otherwise(hi)
        return between(F.greatest(lo, F.lit(LEAST)), F.least(hi, F.lit(MOST)))

    def widened(old: Column, new: Column) -> Column:
        return between(F.when(new["lo"] < old["lo"], LEAST).otherwise(old["lo"]), F.when(new["hi"] > old["hi"], MOST).otherwise(old["hi"]))

    return Lattice(lambda x: F.struct(F.min(x["lo"]).alias("lo"), F.max(x["hi"]).alias("hi")), passed, widened, after)


def between(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


# Path bounds


#: Edges of a graph that one Python call takes for path sums, whose work can be the square of it.
SMALL = 1_000


def path_sums(edges: DataFrame, starts: DataFrame, longest: bool = False, most: int | None = None) -> DataFrame:
    """graph, v, bound, open: the least (greatest) sum of weights of a path from a start (graph, v) to v; where a cycle on the way makes it ever less (more), open is true and bound null.

    edges: graph, src, dst, weight; one with a null weight is no edge. Sums are
    relaxed in rounds of vertices whose bound has moved. A graph whose vertices still
    move after as many rounds as it has vertices has such a cycle among the paths to
    them: they are open, and so is all that they reach. Graphs of up to `most` edges
    take one Python call each, the others rounds of joins, with the same rows.
    """
    sign = -1 if longest else 1
    e = edges.where("graph is not null and src is not null and dst is not null and weight is not null")
    w = e.select("graph", F.col("src").alias("v"), F.col("dst").alias("_to"), (sign * F.col("weight")).cast("long").alias("_w")).groupBy("graph", "v", "_to").agg(F.min("_w").alias("_w"))
    first = starts.select("graph", "v").where("graph is not null and v is not null").distinct()
    # A start is an edge from nowhere, so that it is where its graph is.
    both = w.unionByName(first.select("graph", F.lit(None).cast(dict(w.dtypes)["v"]).alias("v"), F.col("v").alias("_to"), F.lit(0).cast("long").alias("_w")))

    def small(both: DataFrame) -> DataFrame:
        def run(graph, rows: list[tuple]) -> list[tuple]:
            succ, vs = defaultdict(list), {x for r in rows for x in r[1:3]}
            for _, v, to, w in rows:
                succ[v].append((to, w))
            # None is the end of edges from nowhere.
            dist, now = {None: 0}, {None}
            for _ in range(len(vs) + 1):
                last, now = [(v, dist[v]) for v in now], set()
                for v, d in last:
                    for to, w in succ.get(v, ()):
                        if to not in dist or d + w < dist[to]:
                            dist[to] = d + w
                            now.add(to)
            moving = now | reached({v: [to for to, _ in x] for v, x in succ.items()}, now)
            return [(graph, v, None if v in moving else sign * d, v in moving) for v, d in dist.items() if v is not None]

        schema, types = _types(both, graph="graph", v="v")
        return by_key(both, [], run, f"{schema}, bound long, open boolean", types | {"bound": pa.int64(), "open": pa.bool_()})

    def large(both: DataFrame) -> DataFrame:
        w, first = both.where("v is not null"), both.where("v is null").select("graph", F.col("_to").alias("v"))
        size = settled(both.select("graph", F.explode(F.array("v", "_to")).alias("v")).where("v is not null").distinct().groupBy("graph").agg(F.count("*").alias("_n")))
        grown, k = Grown(first.withColumn("bound", F.lit(0).cast("long"))), 0
        moving = settled(first.limit(0))

        def least() -> DataFrame:
            return grown.all().groupBy("graph", "v").agg(F.min("bound").alias("bound"))

        while True:
            k += 1
            # Graphs that are past their number of vertices go no further.
            now = grown.last().join(size.where(F.col("_n") >= k).select("graph"), "graph", "left_semi")
            come = now.join(w, ["graph", "v"]).groupBy("graph", F.col("_to").alias("v")).agg(F.min(F.col("bound") + F.col("_w")).alias("bound"))
            new = come.join(least().select("graph", "v", F.col("bound").alias("_old")), ["graph", "v"], "left").where("_old is null or bound < _old").select("graph", "v", "bound")
            if not grown.add(new):
                break
            late = grown.last().join(size.where(F.col("_n") == k).select("graph"), "graph", "left_semi").select("graph", "v")
            if not late.isEmpty():
                more = settled(moving.unionByName(late))
                unsettle(moving)
                moving = more
        spread = fixpoint(moving, lambda new: new.join(w.select("graph", "v", "_to"), ["graph", "v"]).select("graph", F.col("_to").alias("v"))).withColumn("open", F.lit(True))
        out = settled(least().join(spread, ["graph", "v"], "left").select("graph", "v", F.when(F.col("open").isNull(), sign * F.col("bound")).alias("bound"), F.coalesce("open", F.lit(False)).alias("open")))
        unsettle(size, moving, *grown.rounds)
        return out

    return by_size(both, small, large, SMALL if most is None else most)


def offset_bounds(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """graph, v, low, high: the least and the greatest offset of v from a start, over edges (graph, src, dst, low, high) that add what lies between; null where an end is open."""
    low = path_sums(edges.select("graph", "src", "dst", F.col("low").alias("weight")), starts).select("graph", "v", F.col("bound").alias("low"))
    high = path_sums(edges.select("graph", "src", "dst", F.col("high").alias("weight")), starts, longest=True).select("graph", "v", F.col("bound").alias("high"))
    return low.join(high, ["graph", "v"])


def cycle_signs(edges: DataFrame) -> DataFrame:
    """graph, negative, positive of every graph: whether a cycle has a negative sum of low bounds, and one a positive sum of high bounds. edges: graph, src, dst, low, high."""
    all_starts = vertices(edges.where("graph is not null and src is not null and dst is not null"))
    open_ = lambda c, longest: path_sums(edges.select("graph", "src", "dst", F.col(c).alias("weight")), all_starts, longest).groupBy("graph").agg(F.bool_or("open").alias(c))
    both = open_("low", False).join(open_("high", True), "graph", "full")
    return both.select("graph", F.coalesce("low", F.lit(False)).alias("negative"), F.coalesce("high", F.lit(False)).alias("positive"))


def heights(edges: DataFrame, steps: DataFrame, entries: DataFrame, start: int = 0) -> DataFrame:
    """graph, v, height: the stack height before v; null where ways disagree or a step on the way isn't known. steps: graph, v, step (what v adds; none: 0, null: not known)."""
    known = steps.select("graph", F.col("v").alias("src"), F.coalesce(F.col("step").cast("string"), F.lit("?")).alias("_s")).distinct()
    e = edges.select("graph", "src", "dst").distinct().join(known, ["graph", "src"], "left")
    step = F.when(F.col("_s").isNull(), F.lit(0).cast("long")).otherwise(F.expr("try_cast(_s as bigint)"))
    out = flow(e, entries.select("graph", "v", exactly(F.lit(start)).alias("value")), flat(step))
    return out.select("graph", "v", F.col("value.known").alias("height"))
