"""Graphs as edge tables (graph, src, dst, label), whole-table and per graph.

An edge with a null end is no edge to the operators that go graph by graph, and
joins drop it; an empty table gives an empty one. Columns that begin with an
underscore are theirs. Whole-table operators are joins and loops of joins over all graphs at once.
Those whose result depends on an order of visits run per graph in one Python
call, as control-flow graphs are small.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType

from .tables import Grown, by_key, fixpoint, settled, unsettle


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select("graph", F.explode(F.array("src", "dst")).alias("v")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """graph, v, n_out, n_in."""
    ends = edges.select("graph", F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("graph", F.col("e.v").alias("v")).agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def exits(edges: DataFrame) -> DataFrame:
    """graph, v of vertices without an edge out."""
    return vertices(edges).join(edges.select("graph", F.col("src").alias("v")).distinct(), ["graph", "v"], "left_anti")


def exits_or_none(edges: DataFrame) -> DataFrame:
    """graph, v of exits, and null for a graph that has none: where that is an error, the caller can end the job or tag the graph."""
    return edges.select("graph").distinct().join(exits(edges), "graph", "left")


def virtual_sink(edges: DataFrame, sink: str = "sink") -> DataFrame:
    """edges, and one from each exit to a new vertex."""
    return edges.unionByName(exits(edges).select("graph", F.col("v").alias("src"), F.lit(sink).alias("dst"), F.lit(None).cast("boolean").alias("label")))


#: Edges of a graph that one Python call takes.
SMALL = 5_000


def by_size(edges: DataFrame, small, large, most: int | None = None) -> DataFrame:
    """small(edges) of the graphs that have no more than `most` edges, each in one call, and large(edges), a loop of joins, of the others. Both give the same rows; the size of a graph only chooses how."""
    many = edges.groupBy("graph").agg(F.count("*").alias("_n")).where(F.col("_n") > (SMALL if most is None else most)).select("graph")
    if many.isEmpty():
        return small(edges)
    return small(edges.join(many, "graph", "left_anti")).unionByName(large(edges.join(many, "graph", "left_semi")))


def _types(edges: DataFrame, **columns: str) -> tuple[str, dict]:
    """Schema and Arrow types of result columns, each by the column of edges whose type it has; another name is a number."""
    kinds = {name: edges.schema[c].dataType if c in edges.columns else IntegerType() for name, c in columns.items()}
    return ", ".join(f"{n} {k.simpleString()}" for n, k in kinds.items()), {n: to_arrow_type(k) for n, k in kinds.items()}


def successors(rows) -> dict:
    """Vertex to the vertices that its edges (graph, src, dst) lead to; an edge with a null end is none."""
    out = defaultdict(set)
    for _, s, d, *_ in rows:
        if s is not None and d is not None:
            out[s].add(d)
    return out


def reached(succ: dict, starts) -> set:
    """What a path of one edge or more leads to."""
    seen, todo = set(), list(starts)
    while todo:
        for d in succ.get(todo.pop(), ()):
            if d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """graph, src, dst: pairs with a path of one edge or more; a vertex reaches itself on a loop only."""
    e = edges.select("graph", "src", "dst").where("graph is not null and src is not null and dst is not null").distinct()

    def small(e: DataFrame) -> DataFrame:
        def run(graph, rows):
            succ = successors(rows)
            return [(graph, s, d) for s in list(succ) for d in reached(succ, [s])]

        return by_key(e, ["src", "dst"], run, *_types(e, graph="graph", src="src", dst="dst"))

    def large(e: DataFrame) -> DataFrame:
        return fixpoint(e, lambda new: new.join(e.select("graph", F.col("src").alias("dst"), F.col("dst").alias("_to")), ["graph", "dst"]).select("graph", "src", F.col("_to").alias("dst")))

    return by_size(e, small, large, most)


def depths(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """graph, v, depth: fewest edges from a start (graph, v). A start without edges has depth 0; a graph without a start has no rows."""
    e = edges.select("graph", "src", "dst").where("graph is not null and src is not null and dst is not null").distinct()
    first = starts.select("graph", "v").where("graph is not null and v is not null").distinct()
    # A start is an edge from nowhere, so that it is where its graph is.
    both = e.withColumn("_start", F.lit(False)).unionByName(first.select("graph", F.lit(None).cast(dict(e.dtypes)["src"]).alias("src"), F.col("v").alias("dst"), F.lit(True).alias("_start")))

    def small(both: DataFrame) -> DataFrame:
        def run(graph, rows):
            succ, now = successors(rows), {d for _, s, d, start in rows if start}
            depth, k = dict.fromkeys(now, 0), 0
            while now:
                k += 1
                now = {d for v in now for d in succ.get(v, ()) if d not in depth}
                depth.update(dict.fromkeys(now, k))
            return [(graph, v, k) for v, k in depth.items()]

        return by_key(both, ["src", "dst"], run, *_types(both, graph="graph", v="src", depth="int"))

    def large(both: DataFrame) -> DataFrame:
        e = both.where("not _start").select("graph", F.col("src").alias("v"), F.col("dst").alias("_to"))
        grown, k = Grown(both.where("_start").select("graph", F.col("dst").alias("v"), F.lit(0).alias("depth"))), 1
        while grown.add(grown.last().join(e, ["graph", "v"]).select("graph", F.col("_to").alias("v")).distinct().join(grown.all(), ["graph", "v"], "left_anti").withColumn("depth", F.lit(k))):
            k += 1
        return grown.all()

    return by_size(both, small, large, most)


def reachable_only(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Edges whose source a start reaches."""
    return edges.join(depths(edges, starts).select("graph", F.col("v").alias("src")), ["graph", "src"], "left_semi")


def dataflow(edges: DataFrame, facts: DataFrame, kills: DataFrame | None = None, backward: bool = False) -> DataFrame:
    """graph, v, fact: facts (graph, v, fact) that hold at a vertex by union over its incoming edges; a fact isn't passed on by a vertex that kills it (graph, v, fact)."""
    e = edges.select("graph", F.col("src").alias("v"), F.col("dst").alias("_to")).distinct()
    if backward:
        e = e.select("graph", F.col("_to").alias("v"), F.col("v").alias("_to"))

    def step(new: DataFrame) -> DataFrame:
        alive = new if kills is None else new.join(kills, ["graph", "v", "fact"], "left_anti")
        return alive.join(e, ["graph", "v"]).select("graph", F.col("_to").alias("v"), "fact")

    return fixpoint(facts, step)


def cyclic(edges: DataFrame) -> DataFrame:
    """graph, v of vertices on a cycle."""
    return closure(edges).where("src = dst").select("graph", F.col("src").alias("v"))


def strong_components(edges: DataFrame) -> DataFrame:
    """graph, v, scc: the smallest vertex that v reaches and is reached from."""
    c = closure(edges)
    both = c.join(c.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst")), ["graph", "src", "dst"])
    return vertices(edges).select("graph", F.col("v"), F.col("v").alias("w")).unionByName(both.select("graph", F.col("src").alias("v"), F.col("dst").alias("w"))).groupBy("graph", "v").agg(F.min("w").alias("scc"))


def layers(edges: DataFrame, most: int | None = None) -> DataFrame:
    """graph, v, layer: callees before callers. A vertex on or above a cycle has none, and a graph of such alone gives no row."""
    e = edges.select("graph", "src", "dst").where("graph is not null and src is not null and dst is not null").distinct()

    def small(e: DataFrame) -> DataFrame:
        def run(graph, rows):
            succ, callers = successors(rows), defaultdict(set)
            for s, ds in succ.items():
                for d in ds:
                    callers[d].add(s)
            waits = {v: len(succ.get(v, ())) for v in {*succ, *callers}}
            now, k, out = [v for v, n in waits.items() if not n], 0, []
            while now:
                out += [(graph, v, k) for v in now]
                free = []
                for v in now:
                    for s in callers.get(v, ()):
                        waits[s] -= 1
                        if not waits[s]:
                            free.append(s)
                now, k = free, k + 1
            return out

        return by_key(e, ["src", "dst"], run, *_types(e, graph="graph", v="src", layer="int"))

    def large(e: DataFrame) -> DataFrame:
        # What is left of the graph after each round; a vertex without callees left is free.
        left, todo, grown, k = settled(e), settled(vertices(e)), None, 0
        while True:
            free = todo.join(left.select("graph", F.col("src").alias("v")).distinct(), ["graph", "v"], "left_anti").withColumn("layer", F.lit(k))
            if grown is None:
                grown = Grown(free)
                more = not grown.last().isEmpty()
            else:
                more = grown.add(free)
            if not more:
                unsettle(left, todo)
                return grown.all()
            old, last = (left, todo), grown.last()
            todo = settled(todo.join(last, ["graph", "v"], "left_anti"))
            left = settled(left.join(last.select("graph", F.col("v").alias("dst")), ["graph", "dst"], "left_anti"))
            unsettle(*old)
            k += 1

    return by_size(e, small, large, most)


def chains(edges: DataFrame) -> DataFrame:
    """graph, v, head: straight-line chains. A vertex joins its only predecessor if it is that one's only successor. Heads double their reach each round, and the largest graph bounds the rounds; what still moves after them is on a ring, whose vertices keep their own."""
    e = edges.select("graph", "src", "dst").distinct()
    one = e.groupBy("graph", "src").agg(F.count("*").alias("_o"), F.min("dst").alias("dst")).where("_o = 1").join(e.groupBy("graph", "dst").agg(F.count("*").alias("_i")).where("_i = 1"), ["graph", "dst"]).where("src != dst")
    up = settled(vertices(edges).join(one.select("graph", F.col("dst").alias("v"), F.col("src").alias("up")), ["graph", "v"], "left").select("graph", "v", F.coalesce("up", "v").alias("up")))
    longest = up.where("up != v").groupBy("graph").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    # A vertex k steps from its head is there after log2(k) rounds.
    for _ in range(longest.bit_length() + 1):
        jump = up.select("graph", F.col("v").alias("up"), F.col("up").alias("_next"))
        new = settled(up.join(jump, ["graph", "up"]).select("graph", "v", F.col("_next").alias("up"), (F.col("_next") != F.col("up")).alias("_moved")))
        up = new.select("graph", "v", "up")
        if not new.where("_moved").limit(1).count():
            return up.withColumnRenamed("up", "head")
    rings = up.join(up.select("graph", F.col("v").alias("up"), F.col("up").alias("_of")), ["graph", "up"]).where("up != _of").select("graph", "v")
    return up.join(rings.withColumn("_ring", F.lit(True)), ["graph", "v"], "left").select("graph", "v", F.when(F.col("_ring"), F.col("v")).otherwise(F.col("up")).alias("head"))


def per_graph(edges: DataFrame, f, schema: str) -> DataFrame:
    """f(successors, vertices in order) for each graph; successors: vertex to [(label, vertex)] in order of labels, null before false before true."""

    kinds = {"string": pa.string(), "long": pa.int64()}

    def run(graph, rows: list[tuple]) -> list[tuple]:
        succ = defaultdict(list)
        for _, s, d, label in rows:
            if s is None or d is None:
                continue
            succ[s].append((-1 if label is None else int(label), d))
        for s in succ:
            succ[s].sort()
        return [(graph, *r) for r in f(succ, sorted({v for r in rows for v in r[1:3] if v is not None}))]

    return by_key(edges.select("graph", "src", "dst", "label"), ["src", "dst"], run, schema, {c.split()[0]: kinds[c.split()[1]] for c in schema.split(", ")})


def preorder(succ, root) -> list:
    """Vertices as a depth-first walk meets them."""
    seen, out, todo = set(), [], [root]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            out.append(v)
            todo.extend(d for _, d in reversed(succ.get(v, [])))
    return out


def walk(edges: DataFrame, entry) -> DataFrame:
    """graph, v, step: a depth-first walk from entry(vertices), each vertex once."""
    return per_graph(edges, lambda succ, vs: [(v, i) for i, v in enumerate(preorder(succ, entry(vs)))], "graph string, v string, step long")


def signature(succ, root) -> str:
    """Equal for isomorphic graphs with ordered labelled edges: each vertex by its number in the walk, with the numbers its edges lead to."""
    order = {v: i for i, v in enumerate(preorder(succ, root))}
    return ";".join(",".join(f"{label}>{order[d]}" for label, d in succ.get(v, [])) for v in order)


def signatures(edges: DataFrame, entry=min) -> DataFrame:
    return per_graph(edges, lambda succ, vs: [(signature(succ, entry(vs)),)], "graph string, signature string")


def immediate_dominators(succ, root) -> dict:
    """By intersection along reverse post-order until nothing changes; vertices out of reach have none."""
    post, seen = [], set()

    def visit(v):
        stack = [(v, iter(succ.get(v, [])))]
        seen.add(v)
        while stack:
            u, it = stack[-1]
            for _, d in it:
                if d not in seen:
                    seen.add(d)
                    stack.append((d, iter(succ.get(d, []))))
                    break
            else:
                stack.pop()
                post.append(u)

    visit(root)
    number = {v: i for i, v in enumerate(post)}
    pred = defaultdict(list)
    for v in post:
        for _, d in succ.get(v, []):
            pred[d].append(v)
    idom = {root: root}
    changed = True
    while changed:
        changed = False
        for v in reversed(post[:-1]):
            new = None
            for p in pred[v]:
                if p in idom:
                    a = p
                    if new is None:
                        new = a
                        continue
                    b = new
                    while a != b:
                        while number[a] < number[b]:
                            a = idom[a]
                        while number[b] < number[a]:
                            b = idom[b]
                    new = a
            if idom.get(v) != new:
                idom[v], changed = new, True
    return idom


def dominators(edges: DataFrame, entry=min) -> DataFrame:
    """graph, v, idom, depth in the dominator tree, n_dominated: vertices below v."""

    def run(succ, vs):
        root = entry(vs)
        idom = immediate_dominators(succ, root)
        depth, below = {}, defaultdict(int)
        for v in idom:
            path = [v]
            while path[-1] != root:
                path.append(idom[path[-1]])
            depth[v] = len(path) - 1
            for u in path[1:]:
                below[u] += 1
        return [(v, None if v == root else d, depth[v], below[v]) for v, d in idom.items()]

    return per_graph(edges, run, "graph string, v string, idom string, depth long, n_dominated long")


def elementary_cycles(succ, vs) -> list[list]:
    """Each elementary cycle once, from its smallest vertex. A vertex is searched again only after one it leads to came free."""
    out = []
    nexts = {v: sorted({d for _, d in succ.get(v, [])}) for v in vs}
    for root in vs:
        blocked, waiting, path = set(), defaultdict(set), []

        def free(v):
            todo = [v]
            while todo:
                u = todo.pop()
                if u in blocked:
                    blocked.discard(u)
                    todo.extend(waiting.pop(u, ()))

        # A frame is a vertex, what is left of its successors, and whether a cycle was found below it.
        frames = [[root, iter(nexts[root]), False]]
        path.append(root)
        blocked.add(root)
        while frames:
            frame = frames[-1]
            v = frame[0]
            for d in frame[1]:
                if d == root:
                    out.append(path[:])
                    frame[2] = True
                elif d > root and d not in blocked:
                    frames.append([d, iter(nexts[d]), False])
                    path.append(d)
                    blocked.add(d)
                    break
            else:
                frames.pop()
                path.pop()
                if frame[2]:
                    free(v)
                    if frames:
                        frames[-1][2] = True
                else:
                    for d in nexts[v]:
                        if d > root:
                            waiting[d].add(v)
    return out


def cycles(edges: DataFrame) -> DataFrame:
    return per_graph(edges, lambda succ, vs: [(">".join(c), len(c)) for c in elementary_cycles(succ, vs)], "graph string, cycle string, length long")


def path_bounds(edges: list[tuple], source, longest: bool = False) -> dict:
    """Vertex to the least (or greatest) sum of weights of a path from source; -inf (inf) where a cycle on the way keeps improving it. edges: (src, dst, weight)."""
    sign = -1 if longest else 1
    dist = {source: 0}
    nodes = {v for a, b, _ in edges for v in (a, b)} | {source}
    for improve in (lambda at: at, lambda at: float("-inf")):
        for _ in nodes:
            changed = False
            for a, b, w in edges:
                if a in dist and dist[a] + sign * w < dist.get(b, float("inf")):
                    dist[b], changed = improve(dist[a] + sign * w), True
            if not changed:
                break
    return {v: sign * d for v, d in dist.items()}


def coalesce_labels(edges: DataFrame, nops: DataFrame) -> DataFrame:
    """edges with vertices of nops (graph, v) out of the way, where those have one successor: edges into a chain of them lead to where the chain ends."""
    only = edges.groupBy("graph", F.col("src").alias("v")).agg(F.count("*").alias("_n"), F.min("dst").alias("_to")).where("_n = 1 and v != _to").join(nops, ["graph", "v"], "left_semi").select("graph", "v", "_to")
    hops = fixpoint(only.select("graph", "v", "_to"), lambda new: new.join(only.select("graph", F.col("v").alias("_to"), F.col("_to").alias("_next")), ["graph", "_to"]).where("v != _next").select("graph", "v", F.col("_next").alias("_to")))
    last = hops.join(only.select("graph", F.col("v").alias("_to")), ["graph", "_to"], "left_anti").select("graph", F.col("v").alias("dst"), F.col("_to").alias("_end"))
    gone = last.select("graph", F.col("dst").alias("src"))
    kept = edges.join(gone, ["graph", "src"], "left_anti")
    return kept.join(last, ["graph", "dst"], "left").select("graph", "src", F.coalesce("_end", "dst").alias("dst"), "label").distinct()
