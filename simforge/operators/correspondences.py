"""Correspondences of variables as tables: their parts, and their way over matched blocks.

A pairing says that some names on the left stand for as many on the right. Its
members are rows (key columns, pairing, side, name), side l or r. Pairings that
hold at once cut each other: names in the same pairings are one part, and a part
with more names on one side is a conflict. So refinement is grouping by name and
then by what each name is in, whatever the order in which pairings came.

Rows with a null pairing, side or name say nothing and are left out, repeated
rows count once, and an empty table gives an empty one. A key is grouped by its
names, so one key's pairings are spread over tasks until their parts are put
together; columns that begin with an underscore are theirs.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import _types, by_size
from .tables import by_key, fixpoint, settled


def _known(members: DataFrame, keys: list[str]) -> DataFrame:
    return members.where("pairing is not null and side is not null and name is not null").select(*keys, F.col("pairing").cast("string").alias("pairing"), "side", "name").distinct()


def _sides() -> list[Column]:
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("name"))))
    return [side("l").alias("left"), side("r").alias("right")]


def parts(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part (the pairings it is in, sorted), left, right (names, sorted), agrees: the finest parts of all pairings of a key."""
    named = _known(members, keys).groupBy(*keys, "side", "name").agg(F.array_sort(F.collect_set("pairing")).alias("part"))
    return named.groupBy(*keys, "part").agg(*_sides()).withColumn("agrees", F.size("left") == F.size("right"))


def members_of(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The members of parts, each part a pairing of its own."""
    side = lambda s, c: F.transform(c, lambda x: F.struct(F.lit(s).alias("side"), x.alias("name")))
    return parts.select(*keys, F.array_join("part", " & ").alias("pairing"), F.explode(F.concat(side("l", "left"), side("r", "right"))).alias("_m")).select(*keys, "pairing", "_m.side", "_m.name")


def conflicts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, reason for each part that can't hold; no rows for a key whose pairings agree."""
    return parts.where("not agrees").select(*keys, "part", F.concat_ws(" against ", F.array_join("left", ","), F.array_join("right", ",")).alias("reason"))


def merged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of two lists of pairings that hold at once."""
    return parts(_tagged(first, "1:", keys).unionByName(_tagged(second, "2:", keys)), keys)


def _tagged(members: DataFrame, tag: str, keys: list[str]) -> DataFrame:
    return members.select(*keys, F.concat(F.lit(tag), F.col("pairing").cast("string")).alias("pairing"), "side", "name")


def simplified(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """keys, list (1 or 2), left, right, agrees: the parts that each list is cut into by the other, kept apart. A part in both lists is in the result of both."""
    both = merged(first, second, keys)
    of = lambda tag: F.exists("part", lambda p: p.startswith(tag))
    which = F.filter(F.array(F.when(of("1:"), 1), F.when(of("2:"), 2)), lambda x: x.isNotNull())
    return both.select(*keys, F.explode(which).alias("list"), "left", "right", "agrees")


def verified(members: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """candidates (keys, l, r) with holds: whether l may stand for r, thus whether both are in the same part or in none."""
    named = _known(members, keys).groupBy(*keys, "side", "name").agg(F.array_sort(F.collect_set("pairing")).alias("_part"))
    of = lambda s, c: named.where(F.col("side") == s).select(*keys, F.col("name").alias(c), F.col("_part").alias(f"_{c}"))
    out = candidates.join(of("l", "l"), [*keys, "l"], "left").join(of("r", "r"), [*keys, "r"], "left")
    return out.withColumn("holds", F.col("_l").eqNullSafe(F.col("_r"))).select(*candidates.columns, "holds")


def by_class(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the pairings that terms must have by their class.

    terms: keys, side, name, kind, low, high, base. Registers correspond to
    registers or stack slots, globals to globals, heap arrays to those of the same
    bounds, whose base registers then correspond as well. Terms of an unknown kind
    are in a pairing by the kind's name.
    """
    span = F.concat(F.lit("["), F.coalesce(F.col("low").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("high").cast("string"), F.lit("")), F.lit("]"))
    heap = F.col("kind") == "heap"
    kind = F.when(F.col("kind").isin("reg", "stack"), "frame").when(heap, F.concat(F.lit("heap"), span)).otherwise(F.col("kind"))
    own = terms.select(*keys, kind.alias("pairing"), "side", "name")
    bases = terms.where(heap & F.col("base").isNotNull()).select(*keys, F.concat(F.lit("base"), span).alias("pairing"), "side", F.col("base").alias("name"))
    return own.unionByName(bases)


#: Rows of a cluster (members, steps and names of use) that one Python call takes, which can give the square of it.
SMALL = 1_000


def propagated(members: DataFrame, steps: DataFrame, seen: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """cluster, l, r, pairing of every pairing that reaches a pair of matched blocks.

    members: cluster, l, r, pairing, side, name of what each pair of blocks was
    matched under. steps: cluster, l, r, to_l, to_r, the pairs of blocks that a
    pairing goes on to: successors for what blocks put out, predecessors for what
    they take in. seen: cluster, side, block, name of the names that are of use in a
    block; a pairing goes to a pair of blocks only if it has a name of use in each
    (none: it goes everywhere). A pairing is known by its cluster and name, travels
    as it was found, and stops where nothing new comes. Clusters of up to `most` rows
    take one Python call each. The others go in rounds, each one join over all of
    them for what the last round added, with the same rows.
    """
    members = _known(members.withColumn("pairing", F.concat_ws("@", "pairing", "l", "r")), ["cluster", "l", "r"])
    ways = steps.where("l is not null and r is not null and to_l is not null and to_r is not null").select("cluster", "l", "r", "to_l", "to_r").distinct()
    # One table of all three, so that a cluster's rows come together; a null in _side is a step, one in l and r a name of use.
    rows = members.select(F.col("cluster").alias("graph"), "l", "r", "pairing", F.col("side").alias("_side"), F.col("name").alias("_name")).unionByName(ways.withColumnRenamed("cluster", "graph"), allowMissingColumns=True)
    if seen is not None:
        rows = rows.withColumn("_block", F.lit(None).cast(dict(seen.dtypes)["block"]))
        use = seen.where("side is not null and block is not null and name is not null").select(F.col("cluster").alias("graph"), F.col("side").alias("_side"), F.col("name").alias("_name"), F.col("block").alias("_block")).distinct()
        rows = rows.unionByName(use, allowMissingColumns=True)

    def small(rows: DataFrame) -> DataFrame:
        def run(cluster, rows: list[tuple]) -> list[tuple]:
            names, steps, use, found = defaultdict(set), defaultdict(list), defaultdict(set), set()
            for _, l, r, pairing, side, name, to_l, to_r, *block in rows:
                if block and block[0] is not None:
                    use[side, block[0]].add(name)
                elif side is None:
                    steps[l, r].append((to_l, to_r))
                else:
                    names[pairing, side].add(name)
                    found.add((l, r, pairing))
            todo = [] if cluster is None else list(found)
            while todo:
                l, r, pairing = todo.pop()
                for to in steps.get((l, r), ()):
                    new = (*to, pairing)
                    if new not in found and (everywhere or all(names.get((pairing, s), none) & use.get((s, b), none) for s, b in zip("lr", to))):
                        found.add(new)
                        todo.append(new)
            return [(cluster, *x) for x in found]

        everywhere, none = "_block" not in rows.columns, frozenset()
        return by_key(rows, [], run, *_types(rows, graph="graph", l="l", r="r", pairing="pairing"))

    def large(rows: DataFrame) -> DataFrame:
        use = None
        members, ways = rows.where("pairing is not null"), rows.where("_side is null").select("graph", "l", "r", "to_l", "to_r")
        if seen is not None:
            use = members.select("graph", "pairing", "_side", "_name").join(rows.where("_block is not null").select("graph", "_side", "_block", "_name"), ["graph", "_side", "_name"])
            use = {s: use.where(F.col("_side") == s).select("graph", "pairing", F.col("_block").alias(f"to_{s}")).distinct() for s in "lr"}

        def step(new: DataFrame) -> DataFrame:
            to = new.join(ways, ["graph", "l", "r"]).select("graph", "pairing", "to_l", "to_r")
            for s in "lr" if use else "":
                to = to.join(use[s], ["graph", "pairing", f"to_{s}"], "left_semi")
            return to.select("graph", F.col("to_l").alias("l"), F.col("to_r").alias("r"), "pairing")

        return fixpoint(members.select("graph", "l", "r", "pairing"), step)

    # Sizes are counted first, so the rows are read twice.
    return by_size(settled(rows), small, large, SMALL if most is None else most).withColumnRenamed("graph", "cluster")


def at_blocks(members: DataFrame, steps: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """cluster, l, r, part, left, right, agrees: the parts at each pair of matched blocks once all pairings are where they lead."""
    whose = _known(members.withColumn("pairing", F.concat_ws("@", "pairing", "l", "r")), ["cluster"])
    there = propagated(members, steps, seen)
    return parts(there.join(whose, ["cluster", "pairing"]), ["cluster", "l", "r"])


def settled_pairs(pairs: DataFrame, steps: DataFrame, ins: DataFrame, outs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """pairs (cluster, l, r) with agrees: whether neither what flows out of matched blocks to their successors nor what flows from their inputs to their predecessors is in conflict there.

    steps: cluster, l, r, to_l, to_r along edges. Names of inputs and outputs are the
    functions' own, so along an edge what the source puts out is also held against
    what the target takes in.
    """
    back = steps.select("cluster", F.col("to_l").alias("l"), F.col("to_r").alias("r"), F.col("l").alias("to_l"), F.col("r").alias("to_r"))
    keys = ["cluster", "l", "r"]
    edge = ["cluster", "to_l", "to_r", "l", "r"]
    given = outs.join(steps, keys).select(*edge, "pairing", "side", "name")
    taken = ins.select("cluster", F.col("l").alias("to_l"), F.col("r").alias("to_r"), "pairing", "side", "name").join(steps, ["cluster", "to_l", "to_r"]).select(*edge, "pairing", "side", "name")
    # What only one of the two lists has needn't be balanced against the other.
    along = merged(given, taken, edge).where(F.exists("part", lambda p: p.startswith("1:")) & F.exists("part", lambda p: p.startswith("2:")))
    bad = conflicts(at_blocks(outs, steps, seen), keys).select(*keys).unionByName(conflicts(at_blocks(ins, back, seen), keys).select(*keys))
    bad = bad.unionByName(conflicts(along, edge).select("cluster", F.col("to_l").alias("l"), F.col("to_r").alias("r"))).distinct()
    return pairs.join(bad.withColumn("_bad", F.lit(True)), keys, "left").withColumn("agrees", F.col("_bad").isNull()).drop("_bad")
