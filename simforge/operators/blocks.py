"""Basic blocks: clusters by classifiers, visibility of definitions, frontiers of matches.

Blocks are rows (graph, block); edges are (graph, src, dst, label); definitions
and uses are (graph, var, block). In static single assignment a variable has one
definition. Null blocks or variables take no part. Empty tables give empty
tables. A block number belongs to its graph alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import closure, degrees
from .pairs import measure_vector

#: A classifier: the keys of a block (a column of arrays of strings), given its columns.
CLASSIFIERS: dict[str, Callable[..., Column]] = {}


def classifier(name: str):
    def add(f):
        CLASSIFIERS[name] = f
        return f

    return add


@classifier("function")
def by_function() -> Column:
    """Each name of the block's function."""
    return F.col("symbols")


@classifier("cardinality")
def by_cardinality() -> Column:
    """The number of its outputs."""
    return F.array(F.col("n_outputs").cast("string"))


@classifier("measures")
def by_measures(*measures: str) -> Column:
    """Its measures packed to a bit string."""
    return F.array(F.bin(measure_vector(*[F.col(m) for m in measures or ("n_outputs",)])))


@classifier("tag")
def by_tag() -> Column:
    """The tags that a table gave to its address, joined beforehand as an array."""
    return F.col("tags")


def classify(name: str, *arguments: str) -> Column:
    if name not in CLASSIFIERS:
        raise ValueError(f"no classifier {name}")
    return CLASSIFIERS[name](*arguments)


def with_tags(blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """blocks (addr) with tags, the sorted tags of their address; none: an empty array."""
    t = tags.where("addr is not null and tag is not null").groupBy("addr").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return blocks.join(t, "addr", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def block_clusters(blocks: DataFrame, name: str, *arguments: str) -> DataFrame:
    """key, graph, block: the clusters of a classifier; a block may be in several. Blocks without outputs (n_outputs null) are in none."""
    return blocks.where("n_outputs is not null").select(F.explode(F.array_distinct(classify(name, *arguments))).alias("key"), "graph", "block")


def representatives(clusters: DataFrame, item: str = "block") -> DataFrame:
    """key, item: the smallest item stands for its cluster."""
    return clusters.groupBy("key").agg(F.min(item).alias(item))


def equivalent_clusters(clusters: DataFrame, equal: DataFrame, exhaustive: bool = False) -> DataFrame:
    """a, b (a < b): pairs of clusters (key, item) that are equivalent: their representatives are in equal (l, r), or, exhaustive, any items of theirs. equal is read both ways, and an item equals itself."""
    c = clusters.select("key", "item").distinct() if exhaustive else clusters.groupBy("key").agg(F.min("item").alias("item"))
    links = equal.select("l", "r").unionByName(equal.select(F.col("r").alias("l"), F.col("l").alias("r"))).unionByName(c.select(F.col("item").alias("l"), F.col("item").alias("r"))).distinct()
    left, right = c.select(F.col("key").alias("a"), F.col("item").alias("l")), c.select(F.col("key").alias("b"), F.col("item").alias("r"))
    return left.join(links, "l").join(right, "r").where("a < b").select("a", "b").distinct()


# Visibility


def reachable(edges: DataFrame) -> DataFrame:
    """graph, src, dst: blocks that a path of one edge or more leads to."""
    return closure(edges)


def visible(edges: DataFrame, defs: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """graph, var, block: the blocks that a definition reaches; its own only on a loop."""
    reach = reachable(edges) if reach is None else reach
    return defs.select("graph", "var", F.col("block").alias("src")).join(reach, ["graph", "src"]).select("graph", "var", F.col("dst").alias("block")).distinct()


def useful(edges: DataFrame, defs: DataFrame, uses: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """graph, var, block: blocks that use a variable, and blocks that its definition reaches from which a use in another block than the definition's is reached. A variable without a definition counts in every block from which a use is reached."""
    reach = reachable(edges) if reach is None else reach
    used = uses.select("graph", "var", "block").where("var is not null and block is not null").distinct()
    at = defs.select("graph", "var", F.col("block").alias("def_block"))
    from_use = used.join(at, ["graph", "var"], "left").where("def_block is null or block != def_block")
    ways = from_use.join(reach.select("graph", "src", F.col("dst").alias("block")), ["graph", "block"])
    inner = ways.where("def_block is not null").select("graph", "var", F.col("src").alias("block")).join(visible(edges, defs, reach), ["graph", "var", "block"], "left_semi")
    free = ways.where("def_block is null").select("graph", "var", F.col("src").alias("block"))
    return used.unionByName(inner).unionByName(free).distinct()


def visible_outputs(edges: DataFrame, defs: DataFrame, uses: DataFrame, carried: DataFrame | None = None, conditions: DataFrame | None = None, result: str | None = None) -> DataFrame:
    """defs with is_visible: whether a definition is an output of its block.

    It is if its block branches on it (conditions: graph, var, block), if it is the
    result register (a variable's name up to its version) in a block without a way
    out, or if a block other than its own finds it useful; its own counts where it
    is used before it is defined there (carried: graph, var, block).
    """
    reach = reachable(edges)
    u = useful(edges, defs, uses, reach).select("graph", "var", F.col("block").alias("at"))
    base = defs.select("graph", "var", "block").distinct()
    hits = base.join(u, ["graph", "var"])
    own = hits.where("at = block")
    own = own.join(carried.select("graph", "var", "block").distinct(), ["graph", "var", "block"], "left_semi") if carried is not None else own.limit(0)
    found = hits.where("at != block").select("graph", "var", "block").unionByName(own.select("graph", "var", "block"))
    if conditions is not None:
        found = found.unionByName(base.join(conditions.select("graph", "var", "block").distinct(), ["graph", "var", "block"], "left_semi"))
    if result is not None:
        ends = degrees(edges).where("n_out = 0").select("graph", F.col("v").alias("block"))
        found = found.unionByName(base.where(F.substring_index("var", ".", 1) == result).join(ends, ["graph", "block"], "left_semi").select("graph", "var", "block"))
    found = found.distinct().withColumn("_seen", F.lit(True))
    return defs.join(found, ["graph", "var", "block"], "left").withColumn("is_visible", F.coalesce("_seen", F.lit(False))).drop("_seen")


#: What is kept of a function's outputs, by kind: memory always; others by their visibility.
KINDS = ("reg", "stack", "array", "mem")


def kept_outputs(outputs: DataFrame, well_behaved: Column, reaches_call: Column, stack_register: str = "esp") -> DataFrame:
    """outputs (graph, var, block, kind, high, is_visible) with visible, without adjustments of the stack register in well-behaved functions.

    Stores to memory and to arrays are visible. Those to the stack frame below the
    entry (kind stack, high bound below 0) are if a call is reachable, for its
    arguments, or if they are used; registers if they are used.
    """
    kept = outputs.where(~(well_behaved & (F.col("kind") == "reg") & (F.substring_index("var", ".", 1) == stack_register)))
    local = (F.col("kind") == "stack") & (F.col("high") < 0)
    return kept.withColumn("visible", F.when(local, reaches_call | F.col("is_visible")).when(F.col("kind").isin("mem", "array", "stack"), True).otherwise(F.col("is_visible")))


def visible_assumptions(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (l, r) of variables whose sides are both seen beyond their blocks (left, right: var); what both sides hide needn't correspond."""
    return pairs.join(left.select(F.col("var").alias("l")).distinct(), "l", "left_semi").join(right.select(F.col("var").alias("r")).distinct(), "r", "left_semi")


def frontier(matches: DataFrame, l_edges: DataFrame, r_edges: DataFrame, forward: bool = True) -> DataFrame:
    """graph, l, r: matched blocks where the matched part ends, forward or backward: both have a neighbour outside, or one has and the other has no neighbour at all, or neither has any."""
    a, b = ("src", "dst") if forward else ("dst", "src")

    def counts(edges: DataFrame, side: str) -> DataFrame:
        inside = matches.select("graph", F.col(side).alias(b)).distinct().withColumn("_in", F.lit(True))
        e = edges.select("graph", a, b).distinct().join(inside, ["graph", b], "left")
        return e.groupBy("graph", F.col(a).alias(side)).agg(F.count("*").alias(f"n_{side}"), F.count_if(F.col("_in").isNull()).alias(f"o_{side}"))

    m = matches.select("graph", "l", "r").distinct().join(counts(l_edges, "l"), ["graph", "l"], "left").join(counts(r_edges, "r"), ["graph", "r"], "left").fillna(0, ["n_l", "o_l", "n_r", "o_r"])
    at = ((F.col("o_l") > 0) & (F.col("o_r") > 0)) | ((F.col("o_l") > 0) & (F.col("n_r") == 0)) | ((F.col("n_l") == 0) & (F.col("o_r") > 0)) | ((F.col("n_l") == 0) & (F.col("n_r") == 0))
    return m.where(at).select("graph", "l", "r")
