"""Operators against the cases of FIXTURES.md and against properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from simforge.functions import strided as S
from simforge.operators import expressions as X
from simforge.operators import graphs as G
from simforge.operators import intervals as I
from simforge.operators import matching as M
from simforge.operators import pairs as P

A, B, C = ("var", "A", 32), ("var", "B", 32), ("var", "C", 32)
num = lambda v, w=32: ("int", v, w)
low8 = lambda x: ("cast", "low", 8, x)


def pairing(text):
    return [tuple(frozenset(x.split()) for x in p.split("=")) for p in text.split(";") if p]


@pytest.mark.parametrize("cases, want", [([(0, 4), (5, 6)], [(0, 4), (5, 6)]), ([(0, 4), (4, 6)], [(0, 6)]), ([(0, 4), (7, 8), (4, 7)], [(0, 8)]), ([(0, 4), (8, 9), (10, 12), (14, 15), (1, 62)], [(0, 62)])])
def test_interval_merge(spark, cases, want):
    df = spark.createDataFrame([(1, *c) for c in cases], "k int, lo long, hi long")
    assert sorted((r.lo, r.hi) for r in I.islands(df, ["k"]).collect()) == want


@pytest.mark.parametrize("left, right, want", [("", "", ""), ("", "a=b", "a=b"), ("a b c r=d e f s;g=h", "a k=e l;g x=h y;r=s", "a=e;b c=d f;g=h;k=l;r=s;x=y"), ("a b=c d;g h=i j", "g h=i j", "a b=c d;g h=i j")])
def test_merge(left, right, want):
    assert M.merge(pairing(left), pairing(right)) == M.canonical(pairing(want))


@pytest.mark.parametrize("left, right", [("a=b", "a=c"), ("a=b", "c=b")])
def test_conflicts(left, right):
    with pytest.raises(M.Conflict):
        M.merge(pairing(left), pairing(right))


def test_simplify():
    got = M.simplify(pairing("a b c r=d e f s;g=h"), pairing("a k=e l;g x=h y"))
    assert got == (M.canonical(pairing("a=e;g=h;b c r=d f s")), M.canonical(pairing("a=e;k=l;g=h;x=y")))


@pytest.mark.parametrize("seed", range(100))
def test_random_merges(seed):
    r = random.Random(seed)
    names = [chr(97 + i) for i in range(26)]
    r.shuffle(names)
    ones = list(zip(names[:13], names[13:]))
    groups, at = [], 0
    while at < 13:
        n = r.randint(1, 13 - at)
        groups.append(ones[at : at + n])
        at += n
    sides = [(frozenset(a for a, _ in g), frozenset(b for _, b in g)) for g in groups]
    assert M.merge(sides, sides) == M.canonical(sides)
    if len(groups) > 1:
        (a, b), (c, d) = sides[0], sides[1]
        x, y = min(b), min(d)
        wrong = [(a, b - {x} | {y}), (c, d - {y} | {x}), *sides[2:]]
        with pytest.raises(M.Conflict):
            M.merge(sides, wrong)


@pytest.mark.parametrize(
    "e, want",
    [
        (low8(A), {"A": [(0, 8)]}),
        (("concat", ("extract", 31, 8, A), ("bin", "^", low8(A), ("cast", "high", 8, B))), {"A": [(0, 32)], "B": [(24, 8)]}),
        (("concat", ("extract", 31, 8, A), low8(A)), {"A": [(0, 32)]}),
        (("concat", ("cast", "unsigned", 16, low8(A)), ("cast", "signed", 16, ("extract", 15, 8, B))), {"A": [(0, 8)], "B": [(8, 8)]}),
        (("bin", "&", A, num(0xFF)), {"A": [(0, 8)]}),
        (("bin", "&", A, num(0xF00F)), {"A": [(0, 4), (12, 4)]}),
    ],
)
def test_used_bits(e, want):
    assert {k: X.bit_runs(m) for k, m in X.used_bits(e).items()} == want


LEAF = st.one_of(st.sampled_from([A, B, C]), st.integers(0, 2**32 - 1).map(num), st.sampled_from([num(0), num(1), num(7), num(2**32 - 1)]))
TREE = st.recursive(
    LEAF,
    lambda t: st.one_of(
        st.tuples(st.just("bin"), st.sampled_from(["+", "-", "*", "&", "|", "^", ">>"]), t, t),
        st.tuples(st.just("un"), st.sampled_from(["-", "~"]), t),
        t.map(lambda x: ("cast", "unsigned", 32, low8(x))),
        t.map(lambda x: ("cast", "signed", 32, low8(x))),
        t.map(lambda x: ("val", x)),
        t.map(lambda x: ("cast", "unsigned", 32, ("bin", "==", x, num(0)))),
        st.tuples(t, t).map(lambda p: ("concat", ("extract", 31, 8, p[0]), low8(p[1]))),
        st.tuples(t, t).map(lambda p: ("cast", "unsigned", 32, ("bin", "==", ("bin", "==", ("bin", "-", *p), num(0)), num(0, 1)))),
    ),
    max_leaves=8,
)


@given(TREE, st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
@settings(max_examples=400, deadline=None)
def test_rewriting_keeps_the_value_and_settles(e, a, b, c):
    env = {"A": a, "B": b, "C": c}
    n = X.normal(e)
    assert X.width(n) == X.width(e) and X.evaluate(n, env) == X.evaluate(e, env)
    assert X.normal(n) == n
    assert X.decode(X.encode(n)) == n
    used = X.used_bits(e)
    changed = {k: v ^ (~used.get(k, 0) & 0xFFFFFFFF) for k, v in env.items()}
    assert X.evaluate(e, changed) == X.evaluate(e, env)


def test_rules():
    cases = [
        (("bin", "&", ("bin", ">>", A, num(7)), num(1)), ("bin", ">>", ("cast", "signed", 32, low8(A)), num(31))),
        (("bin", "+", A, ("un", "-", B)), ("bin", "-", A, B)), (("bin", "+", A, num(2**32 - 4)), ("bin", "-", A, num(4))), (("bin", "-", ("bin", "-", A, B), C), ("bin", "-", A, ("bin", "+", B, C))),
        (("bin", "+", num(2), num(3)), num(5)), (("bin", "==", ("bin", "-", A, B), num(0)), ("bin", "==", A, B)), (("bin", "^", A, num(2**32 - 1)), ("un", "~", A)), (("bin", "^", A, num(1)), ("bin", "^", A, num(1))),
        (low8(("concat", ("extract", 31, 8, A), low8(B))), low8(B)), (("cast", "unsigned", 32, low8(A)), ("bin", "&", A, num(255))), (low8(("cast", "unsigned", 32, ("load", ("var", "mem", 0), A, 8))), ("load", ("var", "mem", 0), A, 8)),
    ]
    for e, want in cases:
        assert X.normal(e) == want, e


def test_memory():
    m = ("store", ("var", "mem", 0), num(16), num(0x01020304), 32)
    assert X.evaluate(m, {}, {15: 9}) == {15: 9, 16: 4, 17: 3, 18: 2, 19: 1}
    assert X.evaluate(("load", m, num(17), 16), {}, {}) == 0x0203


def block(*statements):
    return X.transfer_functions(list(statements))


def test_matching():
    entry = block(("t", num(2**32 - 4)))
    one = {"blocks": {-4: entry}, "edges": []}
    assert (lambda m: (m["fuzz"], m["overlap"]))(M.match_functions(one, one)) == ("ExactOnly", "Total")
    b, c, d = (("var", x, 32) for x in "bcd")
    left = {"blocks": {-4: block(("r", ("bin", "+", b, ("bin", "+", d, c))))}, "edges": []}
    right = {"blocks": {-4: block(("q", ("bin", "+", ("bin", "+", ("var", "x", 32), ("var", "y", 32)), ("var", "z", 32))))}, "edges": []}
    m = M.match_functions(left, right)
    assert (m["fuzz"], m["overlap"]) == ("ExactOnly", "Total") and m["known"] == [(frozenset("bcd"), frozenset("xyz"))]
    arm = lambda op: block(("o", ("bin", op, A, B)))
    shape = [(-4, 1, True), (-4, 2, False), (1, -3, None), (2, -3, None)]
    end = block(("e", ("bin", "+", A, num(1))))
    l = {"blocks": {-4: block(("s", A)), 1: arm("*"), 2: arm("-"), -3: end}, "edges": shape}
    r = {"blocks": {-4: block(("s", A)), 1: arm("/"), 2: arm("-"), -3: end}, "edges": shape}
    m = M.match_functions(l, r)
    assert (m["fuzz"], m["overlap"], m["n"], m["d"]) == ("ExactOnly", "Partial", 3, 4)


@pytest.mark.parametrize("d, a, b, want", [(0, 0, 0, "Exact"), (3, 0, 0, "Exact"), (2, 1, 0, "Superset"), (2, 0, 1, "Subset"), (0, 2, 0, "Superset"), (0, 0, 2, "Subset"), (0, 1, 1, "Fail"), (1, 1, 1, "Partial")])
def test_block_kinds(d, a, b, want):
    assert M.block_kind(d, a, b) == want


def test_match_pairs(spark):
    tf = X.encode(("bin", "+", A, B))
    blocks = spark.createDataFrame([(1, s, k, "o", tf) for s in ("left", "right") for k in (-4, 1)] + [(2, "left", -4, "o", tf)], "cluster long, side string, block int, output string, tree string")
    edges = spark.createDataFrame([(1, s, -4, 1, None) for s in ("left", "right")], "cluster long, side string, src int, dst int, label boolean")
    assert [tuple(r) for r in M.match_pairs(blocks, edges).collect()] == [(1, "ExactOnly", "Total", 2, 2, 1.0)]


INTERVAL = st.tuples(st.integers(0, 9), st.integers(-100, 100), st.integers(0, 12)).map(lambda t: S.reduced(t[0], t[1], t[1] + t[0] * t[2], 8) if t[0] else S.constant(t[1], 8))
REAL = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "&": lambda a, b: a & b, "|": lambda a, b: a | b, "^": lambda a, b: a ^ b, "<<": lambda a, b: a << b if 0 <= b < 8 else 0, "s>>": lambda a, b: a >> b if 0 <= b < 8 else 0}


@given(INTERVAL, INTERVAL, st.sampled_from(list(REAL)))
@settings(max_examples=400, deadline=None)
def test_strided_results_hold_all_values(a, b, op):
    got = S.OPERATORS[op](a, b)
    for x in a.values():
        for y in b.values():
            v = REAL[op](x, y) & 255
            v = v - 256 if v > 127 else v
            assert v in got.values()
    u = S.union(a, b)
    assert all(v in u.values() for s in (a, b) for v in s.values())


def test_paths_and_cycles():
    e = [("a", "b", 2), ("a", "c", 5), ("b", "c", 1)]
    assert G.path_bounds(e, "a") == {"a": 0, "b": 2, "c": 3} and G.path_bounds(e, "a", longest=True)["c"] == 5
    assert G.path_bounds([*e, ("c", "b", 1)], "a", longest=True)["c"] == float("inf")
    succ = {1: [(0, 2), (0, 3)], 2: [(0, 1), (0, 3)], 3: [(0, 1)]}
    assert sorted(G.elementary_cycles(succ, [1, 2, 3])) == [[1, 2], [1, 2, 3], [1, 3]]


@pytest.mark.parametrize("edges, want", [("E1 12 23 3X", ["E123X"]), ("E1 12 13 2X 3X", ["E123X", "E132X", "E12X3", "E13X2"]), ("E1 12 23 31 3X", ["E123X"])])
def test_walks(edges, want):
    succ = {}
    for a, b in edges.split():
        succ.setdefault(a, []).append((0, b))
    assert "".join(G.preorder(succ, "E")) in want


def test_chains(spark):
    e = spark.createDataFrame([("g", a, b, None) for a, b in ("ab", "bc", "cd", "ce", "xy", "yx")], "graph string, src string, dst string, label boolean")
    assert {r.v: r.head for r in G.chains(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "x": "x", "y": "y"}


def test_drop_nops(spark):
    e = spark.createDataFrame([("g", a, b, None) for a, b in ("an", "nm", "mz")], "graph string, src string, dst string, label boolean")
    n = spark.createDataFrame([("g", "n"), ("g", "m")], "graph string, v string")
    assert [(r.src, r.dst) for r in G.coalesce_labels(e, n).collect()] == [("a", "z")]


def test_identifiers(spark):
    df = spark.createDataFrame([("f1 g2 f1 h",), ("none",), ("",)], "t string")
    assert [r[0] for r in df.select(P.normal_identifiers(df.t, r"[a-z]\d")).collect()] == ["_1 _2 _1 h", "none", ""]


def test_buckets():
    same = lambda a, b: a % 3 == b % 3
    assert sorted(map(sorted, P.reduce_buckets(list(range(20)), same, 4))) == [[x for x in range(20) if x % 3 == k] for k in range(3)]


def test_strided_columns_are_the_scalars():
    import numpy as np

    from simforge.functions import strided as N

    r = random.Random(3)

    def some():
        if r.random() < 0.3:
            v = r.choice([0, 1, 5, -1, 31, 32, 2**31 - 1, -(2**31), r.randrange(-(2**31), 2**31)])
            return N.Strided(0, v, v)
        lo = r.choice([0, -4, 7, r.randrange(-(2**31), 2**31 - 10), -(2**31)])
        st = r.choice([1, 2, 3, 4, 12, 1000])
        return N.reduced(st, lo, min(lo + st * r.randrange(1, 10**r.randrange(1, 8)), 2**31 - 1))

    pairs = [(some(), some()) for _ in range(4000)]
    a, b = (tuple(np.array([p[k][i] for p in pairs], np.int64) for i in range(3)) for k in (0, 1))
    scalar = N.OPERATORS | {"union": N.union, "neg": lambda x, _: N.neg(x), "not": lambda x, _: N.invert(x)}
    for op, f in scalar.items():
        got = list(zip(*[x.tolist() for x in N.columns(op, a, b)]))
        for (x, y), g in zip(pairs, got):
            assert g == f(x, y)[:3], (op, x, y)


def test_texts_that_are_alike_are_decoded_once(spark, monkeypatch):
    from simforge.operators import expressions as X

    decode, n = X.decode, []
    monkeypatch.setattr(X, "decode", lambda t: n.append(t) or decode(t))
    decoded = X.Decoded()
    assert {decoded[t] for t in ['["int",1,32]', '["int",2,32]'] * 50} == {("int", 1, 32), ("int", 2, 32)} and len(n) == 2
    monkeypatch.setattr(X.Decoded, "MANY", 2)
    assert decoded['["int",3,32]'] == ("int", 3, 32) and len(decoded) == 1
    from pyspark.sql import functions as F

    monkeypatch.undo()
    t = spark.createDataFrame([(1, '["var","a",32]'), (2, None), (3, '["unknown","x"]'), (4, '["var","a",32]')], "a long, t string")
    got = {r.a: r.v for r in t.select("a", X.evaluated(F.col("t"), F.create_map(F.lit("a"), F.col("a"))).alias("v")).collect()}
    assert got == {1: 1, 2: None, 3: None, 4: 4}


def test_nodes_that_stay_are_not_made_anew_and_leaves_meet_no_rules(monkeypatch):
    from simforge.operators import expressions as X

    e = ("bin", "*", ("bin", "-", ("var", "a", 32), ("var", "b", 32)), ("var", "c", 32))
    assert X.mapped(e, lambda x: x) is e
    assert X.mapped(e, lambda x: ("var", "d", 32) if x == ("var", "c", 32) else x)[2] is e[2]
    deep = ("var", "a", 32)
    for _ in range(5_000):
        deep = ("un", "-", deep)
    assert X.depth(X.mapped(deep, lambda x: x)) == 5_001
    seen = []
    monkeypatch.setattr(X, "RULES", [("see", lambda x: seen.append(x[0]) or x)])
    assert X.normal(e, X.RULES) == e and set(seen) == {"bin"}


def test_rules_meet_only_what_they_can_change(spark, monkeypatch):
    from pyspark.sql import functions as F

    from simforge import plans
    from simforge.operators import expressions as X

    # Wherever a rule changes a node, its heads name that node: all rules at all nodes give the same.
    nodes = [("bin", op, a, b) for op in ("+", "-", "==", "^", "&", ">>", "*") for a in (A, num(0), num(2**32 - 1), ("bin", "-", A, B), ("bin", ">>", A, num(7))) for b in (B, num(0), num(1), num(2**32 - 1), ("un", "-", B))]
    nodes += [("cast", kind, w, a) for kind in ("low", "high", "unsigned", "signed") for w in (8, 32) for a in (A, low8(A), ("load", ("var", "mem", 0), A, 8), ("concat", ("extract", 31, 8, A), low8(B)), ("cast", "unsigned", 32, ("bin", "==", A, B)))] + [("val", n) for n in nodes]
    for name, rule in X.RULES:
        for e in nodes:
            assert rule(e) == e or {X.head(e), X.head(e)[:1]} & X.HEADS[rule], (name, e)
    for e in nodes:
        assert X.normal(e) == X.normal(e, [(name, lambda x, rule=rule: rule(x)) for name, rule in X.RULES])
    seen = []
    monkeypatch.setattr(X, "BY_HEAD", X.ByHead([("see", X.fold)]))
    monkeypatch.setattr(X, "HEADS", {X.fold: {("bin",)}})
    X.normal(("un", "-", ("bin", "*", A, B)), [("see", X.fold), ("any", lambda x: seen.append(x[0]) or x)])
    assert set(seen) == {"un", "bin", "var"} and not X.BY_HEAD[("un",)]
    # A table of one row group is spread over tasks before its trees are rewritten.
    t = plans.queries()["t1_t14_rules"](spark, "/root/testdata/sf0.001")
    used = {r.p for r in t.select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(used) == int(spark.conf.get("spark.sql.shuffle.partitions"))
