"""Eight measures of a block's outputs: of the tree, of the block, and of the block's place among those that dominate it.

Outputs are rows (graph, block, output, tree), edges (graph, src, dst, label), as
graphs takes them. Rows with a null graph or block have no measures of their
place, a null tree has none of the tree, and an empty table gives an empty one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import decode, measures
from .graphs import immediate_dominators, per_graph, vertices
from .pairs import measure_vector

#: In the order in which they are packed.
MEASURES = ("depth", "root", "n_outputs", "n_blocks", "dom_depth", "is_dominator", "n_dominated", "n_dominators")


def tree_measures(outputs: DataFrame) -> DataFrame:
    """outputs with depth and root, worked out once for each different tree; a text that is no tree has none."""

    def run(batches):
        for b in batches:
            found = []
            for text in b.column(0).to_pylist():
                try:
                    found.append(measures(decode(text)))
                except (ValueError, TypeError, IndexError, AttributeError):
                    found.append({})
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([m.get(c) for m in found], pa.int32()) for c in ("depth", "root")]], ["tree", "depth", "root"])

    each = outputs.select("tree").where("tree is not null").distinct().mapInArrow(run, "tree string, depth int, root int")
    return outputs.join(each, "tree", "left").select(*outputs.columns, "depth", "root")


def dominator_tree(edges: DataFrame, entry=min) -> DataFrame:
    """graph, v, idom, low, high of the vertices that the entry reaches: their numbers in a walk of the dominator tree, and the last number below them. What v dominates is numbered from low + 1 to high."""

    def run(succ, vs):
        root = entry(vs)
        idom = immediate_dominators(succ, root)
        below: dict = {v: [] for v in idom}
        for v in sorted(idom):
            if v != root:
                below[idom[v]].append(v)
        low, high, todo = {}, {}, [(root, False)]
        while todo:
            v, done = todo.pop()
            if done:
                high[v] = len(low) - 1
                continue
            low[v] = len(low)
            todo += [(v, True), *((d, False) for d in reversed(below[v]))]
        return [(v, None if v == root else idom[v], low[v], high[v]) for v in low]

    return per_graph(edges, run, "graph string, v string, idom string, low long, high long")


def ancestors(tree: DataFrame) -> DataFrame:
    """tree (graph, v, low, high) with n_dominators and n_dominated: the vertices whose numbers enclose v's, and those that v's enclose.

    A vertex opens at low + 1 and closes behind high, so those that are open at a
    number are counted by a running sum over both ends, in one pass over each graph.
    """
    end = lambda at, step: F.struct(at.alias("at"), F.lit(step).alias("step"), F.lit(None).cast("string").alias("v"))
    ends = F.array(end(F.col("low") + 1, 1), end(F.col("high") + 1, -1), F.struct(F.col("low").alias("at"), F.lit(0).alias("step"), F.col("v").cast("string").alias("v")))
    # A range of numbers takes in all ends at the same number.
    w = Window.partitionBy("graph").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    count = tree.select("graph", F.inline(ends)).withColumn("n_dominators", F.sum("step").over(w)).where("v is not null").select("graph", "v", "n_dominators")
    return tree.join(count, ["graph", "v"]).withColumn("n_dominated", F.col("high") - F.col("low"))


def output_measures(outputs: DataFrame, edges: DataFrame, entry=min) -> DataFrame:
    """outputs with the eight MEASURES. Blocks that the entry doesn't reach have no place in the tree."""
    place = ancestors(dominator_tree(edges, entry)).select("graph", F.col("v").alias("block"), F.col("n_dominators").alias("dom_depth"), (F.col("n_dominated") > 0).cast("int").alias("is_dominator"), "n_dominated", "n_dominators")
    blocks = vertices(edges).groupBy("graph").agg(F.count("*").alias("n_blocks"))
    each = outputs.where("output is not null").groupBy("graph", "block").agg(F.count_distinct("output").alias("n_outputs"))
    out = tree_measures(outputs).join(each, ["graph", "block"], "left").join(blocks, "graph", "left").join(place, ["graph", "block"], "left")
    return out.select(*outputs.columns, *MEASURES)


def vector(*names: str) -> Column:
    """The packed measures of these names, all of them if none is given; a missing one counts 0."""
    return measure_vector(*[F.coalesce(F.col(m), F.lit(0)) for m in names or MEASURES])
