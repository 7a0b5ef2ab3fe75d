"""Rewrites as tables: odd rows, and the graph passes they stand for."""

import random

from pyspark.sql import functions as F

from simforge.operators import expressions as X
from simforge.operators import passes as PS
from simforge.operators import rewrites as R

STMTS, EDGES = "graph string, block string, pos long, kind string, text string", "graph string, src string, dst string, label boolean"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_peeling(spark):
    """As the pass does it, on random chains."""
    r = random.Random(1)
    trees = []
    for _ in range(60):
        e = ("bin", r.choice(["==", "!=", "<"]), ("var", "x", 32), ("un", "~", ("int", r.randrange(9), 32)))
        for _ in range(r.randrange(5)):
            e = ("un", "~", e)
        trees.append(e)
    df = spark.createDataFrame([(i, X.encode(e)) for i, e in enumerate(trees)], "i int, c string")
    plain, n = R.peeled(F.col("c"))
    for i, c, k in df.select("i", plain, n).collect():
        f = PS.Function()
        f.blocks, f.edges, f.info = {0: [("cjmp", trees[i])]}, {(0, 1, True), (0, 2, False)}, {}
        PS.normalize_branches(f)
        assert X.decode(c) == f.blocks[0][0][1]
        assert f.edges == ({(0, 1, False), (0, 2, True)} if k % 2 else {(0, 1, True), (0, 2, False)})
    e = spark.createDataFrame([("g", "a", "b", None), ("g", "a", "c", True), ("h", "a", "c", True)], EDGES)
    b = spark.createDataFrame([("g", "a", '["un","~",["var","f",1]]'), ("h", "a", None)], "graph string, block string, condition string")
    t, out = R.normal_branches(b, e)
    assert rows(t) == [("g", "a", '["var","f",1]'), ("h", "a", None)]
    assert rows(out) == [("g", "a", "b", None), ("g", "a", "c", False), ("h", "a", "c", True)]


def test_breaking(spark):
    s = spark.createDataFrame([("g", "a", 0, "call", ""), ("g", "a", 1, "move", ""), ("g", "a", 2, "call", ""), ("g", "b", 0, "move", ""), (None, "a", 0, "call", ""), ("g", None, 0, "call", ""), ("g", "a", None, "call", "")], STMTS)
    e = spark.createDataFrame([("g", "a", "a", True), ("g", "a", "b", False), ("g", "b", "c", None), ("g", "c", None, None)], EDGES)
    t, out = R.broken_after_calls(s, e, F.col("kind") == "call")
    assert rows(t.select("block", "pos")) == [("a", 0), ("a+1", 1), ("a+1", 2), ("b", 0)]
    assert rows(out) == [("g", "a", "a+1", None), ("g", "a+1", "a", True), ("g", "a+1", "b", False), ("g", "b", "c", None)]
    assert [rows(x) for x in R.broken_after_calls(s.limit(0), e.limit(0), F.col("kind") == "call")] == [[], []]


def test_calls_that_do_not_return(spark):
    e = spark.createDataFrame([("g", "a", "b", None), ("g", "b", "c", None), ("g", "b", "d", True), ("g", "c", "d", None)], EDGES)
    at = lambda *v: spark.createDataFrame([("g", x) for x in v], "graph string, v string")
    assert rows(R.without_returns(e, at("b"), at("a"))) == [("g", "a", "b", None), ("g", "b", "d", True)]
    assert rows(R.without_returns(e, at("b").limit(0), at("a"))) == rows(e)


def test_single_exits(spark):
    """As the pass does it, on random blocks."""
    r = random.Random(4)
    s, e, want = [], [], {}
    for g in range(40):
        f = PS.Function()
        n = r.randrange(1, 4)
        f.blocks = {PS.ENTRY: [], PS.EXIT: [], **{i: [("move", "v", ("int", r.randrange(2), 32)) for _ in range(r.randrange(4))] for i in range(n)}}
        f.edges, f.info = {(PS.ENTRY, i, None) for i in range(n)} | {(i, PS.EXIT, None) for i in range(n)}, {}
        s += [(str(g), str(v), k, "move", X.encode(x[2])) for v, b in f.blocks.items() for k, x in enumerate(b)]
        e += [(str(g), str(a), "exit" if b == PS.EXIT else str(b), None) for a, b, _ in f.edges]
        PS.force_single_exit(f)
        name = {PS.EXIT: "exit", n: "tail"}
        want[str(g)] = ({name.get(v, str(v)): [X.encode(x[2]) for x in b] for v, b in f.blocks.items() if b}, {(name.get(a, str(a)), name.get(b, str(b))) for a, b, _ in f.edges})
    t, out = R.single_exit(spark.createDataFrame(s, STMTS), spark.createDataFrame(e, EDGES))
    blocks: dict = {}
    for x in sorted(t.collect(), key=lambda x: x.pos):
        blocks.setdefault(x.graph, {}).setdefault(x.block, []).append(x.text)
    edges: dict = {}
    for x in out.collect():
        edges.setdefault(x.graph, set()).add((x.src, x.dst))
    assert {g: (blocks.get(g, {}), edges[g]) for g in want} == want


def test_sinks(spark):
    df = spark.createDataFrame([(1, "v", 1, "a", True), (1, "v", 2, "b", None), (1, "v", 3, "c", False), (2, "v", 1, "a", True), (2, "v", 2, "b", True), (2, "v", 3, "b", True), (3, "v", 1, "a", False), (None, "v", 1, "a", True)], "graph int, var string, way int, sink string, is_pointer boolean")
    assert rows(R.plausible_sinks(df)) == [(1, "v", "a", None), (1, "v", "b", None), (2, "v", None, "several pointers")]
    assert rows(R.plausible_sinks(df.limit(0))) == []


def test_facts(spark):
    s = spark.createDataFrame([("g", "a", 0, "label", ""), ("g", "a", 1, "halt", ""), ("g", "b", 0, "label", ""), ("g", "b", 1, "call", ""), ("g", "c", 0, "comment", ""), ("g", None, 0, "move", "")], STMTS)
    assert rows(R.block_facts(s)) == [("g", "a", False, True, True, True, 1), ("g", "b", True, False, False, False, 1), ("g", "c", True, False, True, False, 0)]


def test_statements_are_sorted_no_more_than_needed(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = [("g", "a", 1, None), ("g", "a", 2, "x"), ("g", "a", 3, "call"), ("g", "a", 4, "call"), ("g", "b", 1, "call"), ("g", "b", 2, None), ("g", "c", 1, "call")]
    t = spark.createDataFrame(rows, "graph string, block string, pos long, text string")
    e = spark.createDataFrame([("g", "a", "b", None), ("g", "b", "c", None), ("g", "c", "a", None)], "graph string, src string, dst string, label boolean")
    edges = R.broken_after_calls(t, e, F.col("text") == "call")[1]
    assert {(r.src, r.dst) for r in edges.collect()} == {("a", "a+1"), ("a+1", "b"), ("b", "b+1"), ("b+1", "c"), ("c", "a")}
    assert "Window" not in plan(edges)
    # Two statements at one position: only the one behind moves to the tail.
    rows = [("g", "a", 1, "x"), ("g", "a", 2, "p"), ("g", "a", 2, "p"), ("g", "b", 1, "y"), ("g", "b", 2, "p"), ("g", "c", 1, "p"), ("h", "a", 1, "p")]
    t = spark.createDataFrame(rows, "graph string, block string, pos long, text string")
    e = spark.createDataFrame([("g", "a", "exit", None), ("g", "b", "exit", None), ("h", "a", "exit", None)], "graph string, src string, dst string, label boolean")
    stmts = R.single_exit(t, e)[0]
    assert sorted((r.graph, r.block, r.text) for r in stmts.collect()) == [("g", "a", "p"), ("g", "a", "x"), ("g", "b", "y"), ("g", "c", "p"), ("g", "tail", "p"), ("h", "a", "p")]
    assert "LeftAnti" not in plan(stmts)
