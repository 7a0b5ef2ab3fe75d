"""Correspondences, lattices, path bounds, measures and levels of reduction as tables, against plain definitions on random data."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from simforge.operators import correspondences as C
from simforge.operators import graphs as G
from simforge.operators import lattices as L
from simforge.operators import matching as M
from simforge.operators import measures as ME
from simforge.operators import reduction as R
from simforge.operators import tables as T

MEMBERS = "key int, pairing string, side string, name string"


def members(spark, lists):
    """lists: key to pairings as M.merge takes them."""
    rows = [(k, f"p{i}", side, n) for k, ps in lists.items() for i, p in enumerate(ps) for side, names in zip("lr", p) for n in sorted(names)]
    return spark.createDataFrame(rows, MEMBERS)


def pairing(text):
    return [tuple(frozenset(x.split()) for x in p.split("=")) for p in text.split(";") if p]


GOLDEN = {
    1: ("", "a=b", "a=b"),
    2: ("a b c r=d e f s;g=h", "a k=e l;g x=h y;r=s", "a=e;b c=d f;g=h;k=l;r=s;x=y"),
    3: ("a=b;c d=e f;g h=i j;k=l;m=n;o=p;q=r", "g h=i j", "a=b;c d=e f;g h=i j;k=l;m=n;o=p;q=r"),
    4: ("a=b", "a=c", None),
    5: ("a=b", "c=b", None),
}


def test_merge_and_conflicts(spark):
    first, second = (members(spark, {k: pairing(v[i]) for k, v in GOLDEN.items()}) for i in (0, 1))
    parts = C.merged(first, second, ["key"])
    bad = {r.key for r in C.conflicts(parts, ["key"]).collect()}
    assert bad == {4, 5}
    got = defaultdict(list)
    for r in parts.where("agrees").collect():
        got[r.key].append((frozenset(r.left), frozenset(r.right)))
    for k in (1, 2, 3):
        assert M.canonical(got[k]) == M.canonical(pairing(GOLDEN[k][2]))
    again = C.parts(C.members_of(parts, ["key"]), ["key"])
    assert sorted((r.key, r.left, r.right) for r in again.collect()) == sorted((r.key, r.left, r.right) for r in parts.collect())


def test_simplify(spark):
    a, b = (members(spark, {1: pairing(x)}) for x in ("a b c r=d e f s;g=h", "a k=e l;g x=h y"))
    rows = C.simplified(a, b, ["key"]).collect()
    of = lambda k: M.canonical((frozenset(r.left), frozenset(r.right)) for r in rows if r.list == k)
    assert of(1) == M.canonical(pairing("a=e;g=h;b c r=d f s")) and of(2) == M.canonical(pairing("a=e;k=l;g=h;x=y"))
    assert all(r.agrees for r in rows)


def random_pairings(r):
    left, right = list("abcdef"), list("uvwxyz")
    out = []
    for _ in range(r.randrange(1, 4)):
        n = r.randrange(1, 5)
        out.append((frozenset(r.sample(left, n)), frozenset(r.sample(right, n))))
    return out


def test_random_merges_and_pairs(spark):
    r = random.Random(7)
    lists = {k: random_pairings(r) for k in range(150)}
    parts = C.parts(members(spark, lists), ["key"])
    bad = {x.key for x in C.conflicts(parts, ["key"]).collect()}
    got = defaultdict(list)
    for x in parts.collect():
        got[x.key].append((frozenset(x.left), frozenset(x.right)))
    good = {}
    for k, ps in lists.items():
        try:
            good[k] = M.merge(ps, [])
        except M.Conflict:
            assert k in bad
            continue
        assert k not in bad and M.canonical(got[k]) == good[k]
    cand = [(k, a, b) for k in good for a, b in itertools.product("abcdefq", "uvwxyzq")]
    held = {(x.key, x.l, x.r): x.holds for x in C.verified(members(spark, lists), spark.createDataFrame(cand, "key int, l string, r string"), ["key"]).collect()}
    assert held == {c: M.holds(good[c[0]], c[1], c[2]) for c in cand}


def test_classes(spark):
    rows = [(1, "l", "a", "reg", None, None, None), (1, "l", "s", "stack", None, None, None), (1, "l", "h", "heap", 0, 7, "b"), (1, "r", "x", "reg", None, None, None), (1, "r", "y", "reg", None, None, None), (1, "r", "k", "heap", 0, 7, "c"), (2, "l", "g", "global", None, None, None), (2, "r", "z", "reg", None, None, None)]
    terms = spark.createDataFrame(rows, "key int, side string, name string, kind string, low long, high long, base string")
    parts = C.parts(C.by_class(terms, ["key"]), ["key"])
    assert {(tuple(r.left), tuple(r.right)) for r in parts.where("key = 1").collect()} == {(("a", "s"), ("x", "y")), (("h",), ("k",)), (("b",), ("c",))}
    assert {r.key for r in C.conflicts(parts, ["key"]).collect()} == {2}


def test_nulls_and_empty_tables(spark):
    rows = [(1, None, "l", "a"), (1, "p", None, "a"), (1, "p", "l", None), (1, "p", "l", "a"), (1, "p", "l", "a"), (1, "p", "r", "b")]
    df = spark.createDataFrame(rows, MEMBERS)
    assert [(r.left, r.right, r.agrees) for r in C.parts(df, ["key"]).collect()] == [(["a"], ["b"], True)]
    assert C.merged(df.limit(0), df.limit(0), ["key"]).collect() == []
    m = spark.createDataFrame([], "cluster int, l string, r string, pairing string, side string, name string")
    s = spark.createDataFrame([], "cluster int, l string, r string, to_l string, to_r string")
    assert C.propagated(m, s).collect() == [] and C.at_blocks(m, s).collect() == []


def test_flow_as_in_fragments(spark):
    """The table gives the parts that growing a fragment finds, with names of use in some blocks only as well."""
    import test_matching as TM

    for with_use in (False, True):
        rows, steps, seen, want = [], [], [], {}
        for seed in range(30):
            r = random.Random(seed)
            left, right = TM.random_pair(r)
            if with_use:
                for side, s in ((left, "l"), (right, "r")):
                    names = {n for outs in side["blocks"].values() for o, e in outs.items() for n in (o, *TM.X.variables(e))}
                    side["seen"] = {b: {n for n in sorted(names) if r.random() < 0.6} for b in side["blocks"]}
                    seen += [(seed, s, str(b), n) for b, ns in side["seen"].items() for n in ns]
            m = M.match_functions(left, right)
            at = {p[0]: p[1] for p in m["pairs"]}
            for x, y in at.items():
                c = M.compare_blocks(left["blocks"][x], right["blocks"][y])
                rows += [(seed, str(x), str(y), f"{i}", s, n) for i, p in enumerate(c.outs) for s, names in zip("lr", p) for n in names]
                want[seed, str(x)] = m["parts"][x][1]
            steps += [(seed, str(a), str(at[a]), str(b), str(at[b])) for a, b, _ in m["edges"]]
        there = C.at_blocks(
            spark.createDataFrame(rows, "cluster int, l string, r string, pairing string, side string, name string"),
            spark.createDataFrame(steps, "cluster int, l string, r string, to_l string, to_r string"),
            spark.createDataFrame(seen, "cluster int, side string, block string, name string") if with_use else None,
        )
        got = defaultdict(list)
        for x in there.collect():
            assert x.agrees
            got[x.cluster, x.l].append((frozenset(x.left), frozenset(x.right)))
        assert {k: M.canonical(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_conflicts_along_edges(spark):
    m = "cluster int, l string, r string, pairing string, side string, name string"
    outs = spark.createDataFrame([(1, "a", "A", "o", "l", "s"), (1, "a", "A", "o", "r", "p")], m)
    ins = spark.createDataFrame([(1, "b", "B", "i", "l", "s"), (1, "b", "B", "i", "r", "q"), (1, "c", "C", "i", "l", "s"), (1, "c", "C", "i", "r", "p"), (1, "c", "C", "j", "l", "u"), (1, "c", "C", "j", "r", "v")], m)
    pairs = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (1, "c", "C")], "cluster int, l string, r string")
    steps = spark.createDataFrame([(1, "a", "A", "b", "B"), (1, "a", "A", "c", "C")], "cluster int, l string, r string, to_l string, to_r string")
    got = {r.l: r.agrees for r in C.settled_pairs(pairs, steps, ins, outs).collect()}
    # What b takes in is at odds with what a puts out, and so it is with what c takes in, where both meet at a.
    assert got == {"a": False, "b": False, "c": True}


# Graphs


def random_graphs(n=40, vertices=7):
    out = []
    for g in range(n):
        r = random.Random(g)
        vs = [f"v{i}" for i in range(r.randrange(2, vertices))]
        out += [(f"g{g}", r.choice(vs), r.choice(vs), None, r.randrange(-3, 4)) for _ in range(r.randrange(1, 2 * len(vs)))]
    return out


GRAPH = "graph string, src string, dst string, label boolean, weight long"


@pytest.mark.parametrize("most", [None, 0, 5])
def test_graphs_in_one_call_or_in_rounds(spark, most):
    e = spark.createDataFrame(random_graphs(), GRAPH)
    starts = G.vertices(e).groupBy("graph").agg(F.min("v").alias("v"))
    for f in (lambda m: G.closure(e, m), lambda m: G.depths(e, starts, m), lambda m: G.layers(e, m)):
        assert sorted(map(tuple, f(most).collect())) == sorted(map(tuple, f(None).collect()))
    by = defaultdict(set)
    for g, s, d, *_ in random_graphs():
        by[g].add((s, d))
    want = set()
    for g, es in by.items():
        reach = set(es)
        while more := {(a, d) for a, b in reach for c, d in es if b == c} - reach:
            reach |= more
        want |= {(g, *x) for x in reach}
    assert {tuple(r) for r in G.closure(e, most).collect()} == want


def test_long_paths(spark):
    n = 600
    e = spark.createDataFrame([("g", i, i + 1, None) for i in range(n)], "graph string, src int, dst int, label boolean")
    starts = spark.createDataFrame([("g", 0)], "graph string, v int")
    assert G.depths(e, starts).agg(F.max("depth")).first()[0] == n
    assert G.layers(e).agg(F.max("layer")).first()[0] == n


def test_rounds_leave_few_files(spark):
    import os

    at = T.shared_dir(spark)
    before = set(os.listdir(at))
    e = spark.createDataFrame([("g", i, i + 1, None) for i in range(30)], "graph string, src int, dst int, label boolean")
    out = G.closure(e, 0)
    assert out.count() == 30 * 31 // 2
    assert len(set(os.listdir(at)) - before) <= T.Grown.MANY


def test_path_sums(spark):
    rows = random_graphs(60)
    e = spark.createDataFrame(rows, GRAPH)
    starts = G.vertices(e).groupBy("graph").agg(F.min("v").alias("v"))
    by = defaultdict(list)
    for g, s, d, _, w in rows:
        by[g].append((s, d, w))
    for longest in (False, True):
        got = {(r.graph, r.v): float("inf" if longest else "-inf") if r.open else r.bound for r in L.path_sums(e, starts, longest).collect()}
        assert got == {(g, v): x for g, es in by.items() for v, x in G.path_bounds(es, min(v for s, d, _ in es for v in (s, d)), longest).items()}


def test_cycle_signs(spark):
    from simforge.operators.regions import cycle_signs

    rows = [(*r[:4], r[4], r[4] + random.Random(i).randrange(3)) for i, r in enumerate(random_graphs(60))]
    e = spark.createDataFrame(rows, "graph string, src string, dst string, label boolean, low long, high long")
    by = defaultdict(list)
    for g, s, d, _, lo, hi in rows:
        by[g].append((s, d, lo, hi))
    assert {r.graph: (r.negative, r.positive) for r in L.cycle_signs(e).collect()} == {g: cycle_signs(es) for g, es in by.items()}


def test_heights(spark):
    from simforge.operators.regions import stack_heights

    rows, steps, by = random_graphs(60), [], defaultdict(list)
    for g, s, d, *_ in rows:
        by[g].append((s, d))
    want = {}
    for g, es in by.items():
        r = random.Random(g)
        vs = sorted({v for e in es for v in e})
        deltas = {v: r.choice([0, 0, 4, -4, None]) for v in vs if r.random() < 0.7}
        steps += [(g, v, x) for v, x in deltas.items()]
        want |= {(g, v): h for v, h in stack_heights(es, deltas, entry=vs[0]).items()}
    e = spark.createDataFrame(rows, GRAPH)
    got = L.heights(e, spark.createDataFrame(steps, "graph string, v string, step int"), G.vertices(e).groupBy("graph").agg(F.min("v").alias("v")))
    assert {(r.graph, r.v): r.height for r in got.collect()} == want


def test_intervals_widen(spark):
    e = spark.createDataFrame([("g", "a", "b", 1, 2), ("g", "b", "b", 0, 4), ("g", "b", "c", -1, -1), ("g", "c", "d", None, 1), (None, "a", "x", 1, 1), ("g", "a", None, 1, 1)], "graph string, src string, dst string, low long, high long")
    start = spark.createDataFrame([("g", "a")], "graph string, v string").withColumn("value", L.between(F.lit(0), F.lit(0)))
    got = {r.v: (r.value.lo, r.value.hi) for r in L.flow(e, start, L.ranges(F.col("low"), F.col("high"))).collect()}
    assert got == {"a": (0, 0), "b": (1, L.MOST), "c": (0, L.MOST), "d": (L.LEAST, L.MOST)}
    assert L.flow(e.limit(0), start.limit(0), L.ranges(F.col("low"), F.col("high"))).collect() == []


# Measures and reduction


def test_dominators_by_intervals(spark):
    e = spark.createDataFrame(random_graphs(40), GRAPH).select("graph", "src", "dst", "label")
    got = {(r.graph, r.v): (r.n_dominators, r.n_dominated) for r in ME.ancestors(ME.dominator_tree(e)).collect()}
    assert got == {(r.graph, r.v): (r.depth, r.n_dominated) for r in G.dominators(e).collect()}


def test_measures_of_odd_rows(spark):
    e = spark.createDataFrame([("g", "a", "b", None)], "graph string, src string, dst string, label boolean")
    o = spark.createDataFrame([("g", "a", "x", '["int",1,32]'), ("g", "z", "y", None), (None, "a", "x", "no tree"), ("g", "b", None, '["un","-",["var","v",32]]')], "graph string, block string, output string, tree string")
    got = {(r.graph, r.block): tuple(r[m] for m in ME.MEASURES) for r in ME.output_measures(o, e).collect()}
    assert got[("g", "a")] == (1, 11, 1, 2, 0, 1, 1, 0)
    assert got[("g", "z")] == (None, None, 1, 2, None, None, None, None)
    assert got[("g", "b")] == (2, 6, None, 2, 1, 0, 0, 1)
    assert got[(None, "a")] == (None,) * 8
    assert ME.output_measures(o, e).select(ME.vector().alias("x")).count() == 4


@pytest.mark.parametrize("slots, fan", [(1, 2), (4, 2), (7, 3), (16, 4)])
def test_levels_of_reduction(spark, slots, fan):
    r = random.Random(slots)
    items = [(r.randrange(3), i, r.randrange(60)) for i in range(400)]
    same = lambda a, b: a % 13 == b % 13
    from simforge.operators.pairs import greedy_buckets

    want = {}
    for g in range(3):
        for b in greedy_buckets([x for x in items if x[0] == g], lambda x, y: same(x[2], y[2])):
            want |= {(g, x[1]): min(y[1] for y in b) for x in b}
    df = spark.createDataFrame([*items, items[0], (None, 1, 1), (1, None, 1), (1, 1000, None)], "grp int, item int, value int")
    got = R.reduced_buckets(df, same, slots, fan)
    assert {(x.grp, x.item): x.first for x in got.collect()} == want
    assert R.reduced_buckets(df.limit(0), same, slots, fan).collect() == []


def test_a_group_is_spread(spark):
    """No call holds a group: each sees the items of its slot, and then representatives."""
    held = []
    seen = spark.sparkContext.accumulator(0)

    def same(a, b):
        seen.add(1)
        return a % 2 == b % 2

    df = spark.createDataFrame([(0, i, i) for i in range(300)], "grp int, item int, value int")
    assert {x.first for x in R.reduced_buckets(df, same, 8, 2).collect()} == {0, 1} and not held
    # Each item is held against two buckets at most, in its slot and then as one of two representatives.
    assert seen.value <= 2 * (300 + 2 * (8 + 4 + 2))


def test_memo(spark):
    rows = [(1, 2, True), (2, 1, True), (1, 2, True), (3, 4, False), (5, 6, True), (6, 5, False), (None, 1, True)]
    memo = R.verdict_memo(spark.createDataFrame(rows, "l int, r int, verdict boolean"))
    assert sorted(tuple(x) for x in memo.collect()) == [(1, 2, True, 3, 2, None), (3, 4, False, 1, 0, None), (5, 6, None, 2, 1, "put in twice")]
    assert tuple(R.hit_rate(memo).first()) == (6, 3, 0.5)


# Data that trigger


def test_passes_change_what_they_are_for(spark):
    """Each step that can change a program, and is no second run of one that has nothing left to do, changes some of the richer programs."""
    from simforge import plans

    rows = {r.name: (r.n_changed, r.n_cfg_changed) for r in plans.queries()["k8_rich_snapshots"](spark, "/root/testdata/sf0.001").collect()}
    notes_only = {"CollectCalls", "AddressMap", "Definitions1", "Definitions2", "FindCollapsible", "MarkLiveout"}
    again = {"Prune2", "Simplify2", "Simplify3", "DeadCode2", "CoalesceSsa2"}
    # An indirect jump ends the run of a function before, so that nothing is left of it to remove.
    assert {n for n, (changed, _) in rows.items() if not changed} == notes_only | again | {"RemoveIndirect"}
    assert all(rows[n][1] for n in ("Prune1", "ForceSingleExit", "NormalizeBranches", "DropNops1", "RemoveNoreturnEdges"))


def test_sets_are_finite_and_narrow(spark):
    from simforge import plans

    q = plans.queries()
    joined = q["g26_joined_sets"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n for r in joined) > 100 and sum(r.n_wide for r in joined) > 0
    assert {r.bits for r in q["n11_narrow_uses"](spark, "/root/testdata/sf0.001").collect()} == {8, 16}


def test_all_kinds_of_matches_occur(spark):
    from simforge import plans

    q, d = plans.queries(), "/root/testdata/sf0.01"
    assert {r.kind for r in q["m8_block_kinds"](spark, d).collect()} == {"Exact", "Subset", "Superset", "Partial"}
    classes = {(r.fuzz, r.overlap) for r in q["m8_copies_fuzzy"](spark, d).collect()}
    assert {f for f, _ in classes} == {"ExactOnly", "SubsetAndExact", "SupersetAndExact", "Fuzzy"} and {o for _, o in classes} >= {"Total", "Subset", "Partial"}


def test_small_clusters_and_graphs_take_no_rounds(spark, monkeypatch):
    """One Python call each gives what rounds of joins give, with names of use in some blocks only and nulls as well."""
    r = random.Random(11)
    rows, steps, seen = [(9, None, "a0", "p", "l", "x"), (9, "a0", "b0", None, "l", "x"), (None, "a0", "b0", "p", "l", "x")], [(9, None, "b0", "a1", "b1"), (None, "a0", "b0", "a1", "b1")], [(9, "l", None, "x"), (9, None, "a1", "x")]
    for c in range(25):
        n = r.randrange(1, 7)
        steps += [(c, f"a{x}", f"b{x}", f"a{y}", f"b{y}") for x, y in {(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(2 * n))}]
        rows += [(c, f"a{x}", f"b{x}", f"p{r.randrange(2)}", s, r.choice("xyz")) for x in range(n) for s in "lr" if r.random() < 0.7]
        seen += [(c, s, f"{'ab'[s == 'r']}{x}", name) for x in range(n) for s in "lr" for name in "xyz" if r.random() < 0.5]
    m = spark.createDataFrame(rows, "cluster int, l string, r string, pairing string, side string, name string")
    t = spark.createDataFrame(steps, "cluster int, l string, r string, to_l string, to_r string")
    u = spark.createDataFrame(seen, "cluster int, side string, block string, name string")
    w = spark.createDataFrame(random_graphs() + [("n", None, "a", None, 1), ("n", "a", "b", None, None), (None, "a", "b", None, 1)], GRAPH).drop("label")
    starts = spark.createDataFrame([(f"g{g}", f"v{v}") for g in range(40) for v in r.sample(range(7), g % 3)] + [("n", "a"), ("n", None), (None, "a"), ("new", "a")], "graph string, v string")
    key = lambda x: tuple((v is not None, v) for v in x)
    flow = lambda seen, most: sorted((tuple(x) for x in C.propagated(m, t, seen, most).collect()), key=key)
    sums = lambda longest, most: sorted(tuple(x) for x in L.path_sums(w, starts, longest, most).select("graph", "v", F.coalesce("bound", F.lit(0)), "open").collect())
    in_rounds = [flow(None, 0), flow(u, 0), sums(False, 0), sums(True, 0)]
    assert in_rounds[0] != in_rounds[1] and {x[3] for x in in_rounds[2]} == {True, False} and all(flow(x, 12) == y for x, y in zip((None, u), in_rounds)) and sums(False, 4) == in_rounds[2]

    def rounds(*_):
        raise AssertionError("rounds")

    monkeypatch.setattr(C, "fixpoint", rounds)
    monkeypatch.setattr(L, "fixpoint", rounds)
    monkeypatch.setattr(L, "Grown", rounds)
    assert [flow(None, None), flow(u, None), sums(False, None), sums(True, None)] == in_rounds
