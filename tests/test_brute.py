"""Graph queries without SQL, held against plain definitions on all graphs of the smallest tables."""

from collections import defaultdict
from itertools import permutations

import pytest

from simforge import plans
from simforge.operators import graphs as G
from simforge.plans import encode as E

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graphs(spark):
    out = defaultdict(set)
    for r in E.edges(spark, SF).collect():
        out[r.graph].add((r.src, r.dst, r.label))
    return out


def rows(spark, name):
    return plans.queries()[name](spark, SF).collect()


def followers(edges, v):
    return [d for _, d in sorted((-1 if label is None else int(label), d) for s, d, label in edges if s == v)]


def walked(edges):
    order = []

    def go(v):
        if v not in order:
            order.append(v)
            for d in followers(edges, v):
                go(d)

    go(min(v for e in edges for v in e[:2]))
    return order


def test_walks(spark, graphs):
    got = defaultdict(dict)
    for r in rows(spark, "g3_walks"):
        got[r.graph][r.step] = r.v
    assert {g: [x[i] for i in range(len(x))] for g, x in got.items()} == {g: walked(e) for g, e in graphs.items()}


def test_isomorphic_graphs_share_a_signature(spark, graphs):
    def shape(edges):
        number = {v: i for i, v in enumerate(walked(edges))}
        return frozenset((number[s], number[d], label) for s, d, label in edges if s in number)

    got = {r.graph: r.signature for r in G.signatures(E.edges(spark, SF)).collect()}
    by_shape, by_signature = defaultdict(set), defaultdict(set)
    for g, e in graphs.items():
        # Parallel edges between two vertices come in the order of their labels.
        by_shape[shape(e)].add(g)
        by_signature[got[g]].add(g)
    assert sorted(map(sorted, by_shape.values())) == sorted(map(sorted, by_signature.values()))
    assert sum(r.n for r in rows(spark, "g13_isomorphic_graphs")) == len(graphs)


def test_elementary_cycles(spark, graphs):
    want = set()
    for g, edges in graphs.items():
        ways = {(s, d) for s, d, _ in edges}
        vs = sorted({v for e in ways for v in e})
        for n in range(1, len(vs) + 1):
            for c in permutations(vs, n):
                if c[0] == min(c) and all(w in ways for w in zip(c, c[1:] + c[:1])):
                    want.add((g, ">".join(c), n))
    assert {tuple(r) for r in rows(spark, "g18_elementary_cycles")} == want


def test_chains(spark, graphs):
    want = set()
    for g, edges in graphs.items():
        ways = {(s, d) for s, d, _ in edges}
        above = {}
        for s, d in ways:
            if s != d and sum(x == s for x, _ in ways) == 1 and sum(y == d for _, y in ways) == 1:
                above[d] = s
        for v in {v for e in ways for v in e}:
            at, seen = v, []
            while at in above and at not in seen:
                seen.append(at)
                at = above[at]
            want.add((g, v, v if at in seen else at))
    assert {(r.graph, r.v, r.head) for r in rows(spark, "g8_chains")} == want


def test_dropped_nops(spark, graphs):
    want = set()
    for g, edges in graphs.items():
        to = {}
        for v in {v for e in edges for v in e[:2]} & {"error"}:
            out = [e for e in edges if e[0] == v]
            if len(out) == 1 and out[0][1] != v:
                to[v] = out[0][1]
        want |= {(g, s, to.get(d, d), label) for s, d, label in edges if s not in to}
    assert {(r.graph, r.src, r.dst, r.label) for r in rows(spark, "g9_drop_nops")} == want


def test_matched_functions(spark):
    """Both functions of a pair are one straight line of blocks: no more of them match than either has, and equal functions match in whole."""
    got = rows(spark, "m8_match_functions")
    assert {r.fuzz for r in got} <= {"ExactOnly", "SubsetAndExact", "SupersetAndExact", "Fuzzy"} and sum(r.n for r in got) > 0


def test_null_ends_and_empty_tables(spark):
    df = spark.createDataFrame([("g", "a", None, None), ("g", "a", "b", None), ("g", None, "b", True)], "graph string, src string, dst string, label boolean")
    assert [(r.v, r.step) for r in G.walk(df, min).collect()] == [("a", 0), ("b", 1)]
    empty = df.limit(0)
    assert G.chains(empty).collect() == [] and G.cycles(empty).collect() == [] and G.closure(empty).collect() == []


def test_shared_names_over_long_ways(spark):
    from simforge.operators.pairs import shared_names

    rows = [(i, f"n{i}") for i in range(60)] + [(i, f"n{i + 1}") for i in range(60)] + [(100, "x"), (101, "x"), (102, None)]
    got = {r.item: r.same for r in shared_names(spark.createDataFrame(rows, "item int, name string"), "item", "name").collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100, 102: 102}
