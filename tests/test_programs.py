"""Passes and analyses of whole functions, held against running them."""

import random

import pytest
from pyspark.sql import functions as F

from simforge.operators import memory_passes as M
from simforge.operators import passes as P
from simforge.operators import programs as T
from simforge.operators.expressions import depth, encode, evaluate, mapped, walk
from simforge.operators.graphs import elementary_cycles
from simforge.operators.matching import by_class

V = lambda n: ("var", n, 32)
num = lambda v: ("int", v, 32)
add = lambda a, b: ("bin", "+", a, b)
MEM = ("var", "mem", 0)


def run(f, env, memory, steps=400):
    """The last value of eax when the exit is reached, or None; a phi has the value of its latest argument."""
    values, memories, when, clock, at = dict(env), {}, {}, 0, P.ENTRY
    last = None

    def arrays(name):
        return memories.get(name, memory)

    def of(e):
        node = {}
        for x in reversed(list(walk(e))):
            if x[0] == "load":
                a = of(x[2])
                node[x] = ("int", sum(arrays(x[1][1]).get(a + k, (a + k) * 7 % 256) << 8 * k for k in range(x[3] // 8)), x[3])
        return evaluate(mapped(e, lambda x: node.get(x, x)), {n: values.get(n, 0) for n in {x[1] for x in walk(e) if x[0] == "var"}})

    for _ in range(steps):
        taken = None
        for s in f.blocks[at]:
            clock += 1
            if s[0] == "move":
                name, e = s[1], s[2]
                if e[0] == "store":
                    m = dict(arrays(e[1][1]))
                    a, v = of(e[2]), of(e[3])
                    m.update({a + k: v >> 8 * k & 255 for k in range(e[4] // 8)})
                    memories[name] = m
                elif e[0] == "phi":
                    src = max(e[1:], key=lambda x: when.get(x[1], -1))[1]
                    if src in memories or name.startswith(("mem", "esp[")):
                        memories[name] = arrays(src)
                    else:
                        values[name] = values.get(src, env.get(src.split(".")[0], 0) if src not in when else 0)
                elif e[0] == "var" and e[2] == 0:
                    memories[name] = arrays(e[1])
                else:
                    values[name] = of(e)
                when[name] = clock
                if name.split(".")[0] == "eax":
                    last = values.get(name)
            elif s[0] == "cjmp":
                taken = bool(of(s[1]) & 1)
        if at == P.EXIT:
            return last
        ways = f.out(at)
        if not ways:
            return last
        at = next((d for _, d, label in ways if label is taken), ways[0][1]) if taken is not None else ways[0][1]
    return None


def program(seed):
    r = random.Random(seed)
    n = r.randint(3, 14)
    out = []
    for k in range(n):
        out.append(("label", f"L{k}"))
        a, b, c = (f"v{r.randrange(4)}" for _ in range(3))
        place = add(V("esp"), num(4 * r.randrange(3)))
        kind = r.randrange(5)
        if kind == 0:
            out.append(("move", a, add(V(b), num(r.randrange(9)))))
        elif kind == 1:
            out.append(("move", a, ("load", MEM, place, 32)))
        elif kind == 2:
            out.append(("move", "mem", ("store", MEM, place, V(c), 32)))
        elif kind == 3 and k + 2 < n:
            out.append(("cjmp", ("bin", "==", V(a), num(r.randrange(3))), f"L{r.randrange(k + 1, n)}", f"L{k + 1}"))
        else:
            out.append(("move", a, ("bin", r.choice("+-^&"), V(b), V(c))))
    return [*out, ("label", "end"), ("move", "eax", V("v0")), ("halt",)]


@pytest.mark.parametrize("seed", range(60))
def test_passes_keep_the_result(seed):
    raw = program(seed)
    before = P.from_statements(raw)
    # A phi doesn't say which way each argument comes, so it is run by their order in time, which hoisting changes.
    branches = any(s[0] == "cjmp" for s in raw)
    after, why = P.run_passes(P.from_statements(raw), [x for x in P.pipeline() if not branches or x[0] != "Buoyancy"])
    assert why is None
    for start in range(3):
        env = {f"v{i}": start * i for i in range(4)} | {"esp": 4096}
        want = run(before, env, {})
        named = dict(env)
        assert run(after, named, {}) == want


@pytest.mark.parametrize("seed", range(20))
def test_layout_gives_the_graph_again(seed):
    f = P.from_statements(program(seed))
    P.prune(f)
    g = P.from_statements(M.layout(f))
    P.prune(g)
    env = {f"v{i}": i for i in range(4)} | {"esp": 64}
    assert run(f, env, {}) == run(g, env, {})


def test_value_sets_hold_what_runs_give():
    f = P.from_statements([("move", "i", num(0)), ("label", "top"), ("move", "i", add(V("i"), num(4))), ("cjmp", ("bin", "==", V("i"), num(40)), "out", "top"), ("label", "out"), ("move", "j", ("bin", "&", V("i"), num(7))), ("move", "eax", V("j")), ("halt",)])
    for _, p in T.TO_SSA:
        p(f)
    sets = M.value_sets(f)
    assert sets["i.1"][:3] == (0, 0, 0) and sets["j.1"].lo == 0 and sets["j.1"].hi == 7
    assert M.value_sets(P.from_statements([])) == {}


def test_bits_that_nothing_uses_are_trimmed():
    low = lambda e: ("cast", "low", 8, e)
    f = P.Function({P.ENTRY: [], 0: [("move", "a", add(V("b"), num(1))), ("move", "c", low(V("a"))), ("move", "a", num(0)), ("move", "d", num(5)), ("move", "d", num(6))], P.EXIT: []}, {(P.ENTRY, 0, None), (0, P.EXIT, None)})
    M.trim_definitions(f)
    assert f.blocks[0][0] == ("move", "a", ("cast", "unsigned", 32, low(add(V("b"), num(1)))))
    assert [s[1] for s in f.blocks[0]] == ["a", "c", "a", "d"]


def test_calls_leave_registers_and_memory_undefined():
    f = P.from_statements([("move", "eax", num(1)), ("call", "f"), ("move", "x", ("load", MEM, V("p"), 32)), ("call", "g")])
    M.summarize_calls(f)
    lost = [s[1] for *_, s in f.statements() if s[0] == "move" and s[2][0] == "unknown"]
    assert lost == ["eax", "mem", "eax"]


def test_trivial_load_becomes_the_stored_value():
    place = add(V("esp"), num(8))
    f, why = P.run_passes(P.from_statements([("move", "mem", ("store", MEM, place, V("a"), 32)), ("move", "mem", ("store", MEM, add(V("esp"), num(16)), V("b"), 32)), ("move", "eax", ("load", MEM, place, 32)), ("halt",)]))
    assert why is None and f.info["arrays"] == ["esp[16:19]", "esp[8:11]"]
    f = P.from_statements([("move", "mem", ("store", MEM, place, V("a"), 32)), ("move", "eax", ("load", MEM, place, 32)), ("halt",)])
    for name in ("RemoveHalts", "StartSsa", "NameArrays", "CollapseLoads"):
        P.registered()[name](f)
    assert [s[2] for *_, s in f.statements() if s[0] == "move" and s[1].startswith("eax")] == [V("a")]


def test_other_registered_passes():
    f = P.Function({P.ENTRY: [], 0: [("special", "x"), ("move", "a", ("bin", "+", ("var", "b", 8), num(1)))], P.EXIT: []}, set())
    P.registered()["RemoveSpecial"](f)
    P.registered()["Coerce"](f)
    assert f.blocks[0] == [("move", "a", ("bin", "+", ("cast", "unsigned", 32, ("var", "b", 8)), num(1)))]
    f = P.Function({0: [("move", "p", ("phi", V("a"), V("b"))), ("move", "q", ("phi", V("p"), V("c")))]}, set())
    M.propagate_phis(f)
    assert f.blocks[0][1] == ("move", "q", ("phi", V("a"), V("b"), V("c")))
    f = P.Function({P.ENTRY: [], 0: [("move", "x", add(V("a"), num(1))), ("cjmp", V("z"))], 1: [("move", "eax", V("x"))], 2: [], P.EXIT: []}, {(P.ENTRY, 0, None), (0, 1, True), (0, 2, False), (1, P.EXIT, None), (2, P.EXIT, None)})
    M.sink_partial(f)
    assert f.blocks[0] == [("cjmp", V("z"))] and f.blocks[1][0][1] == "x"
    M.replace_by_error(f, 1)
    assert (0, P.ERROR, True) in f.edges and 1 not in f.blocks
    assert set(P.registered()) >= {n for n, _ in P.pipeline()}


def test_any_error_is_tagged():
    def broken(f):
        raise ZeroDivisionError("no")

    assert P.run_passes(P.from_statements([]), [("Broken", broken)])[1] == "Broken: ZeroDivisionError: no"


def test_long_rings_and_deep_trees():
    ring = {i: [(0, (i + 1) % 3001)] for i in range(3001)}
    assert len(elementary_cycles(ring, [0, 1, 2, *range(3, 3001)])[0]) == 3001
    e = V("a")
    for _ in range(5000):
        e = add(e, num(1))
    assert depth(e) == 5001


def test_counts_of_variables():
    assert M.count_variables(("ite", V("c"), V("a"), V("b"))) == 1
    with pytest.raises(P.Confusing):
        M.count_variables(("load", MEM, V("a"), 32))


def test_classes_must_have_equal_sizes():
    assert by_class({"a": ("reg",), "s": ("stack",)}, {"x": ("reg",), "y": ("reg",)}) == [(frozenset("as"), frozenset("xy"))]
    assert by_class({"a": ("reg",)}, {"x": ("global",)}) is None
    heap = by_class({"h": ("heap", 0, 7, "b"), "b": ("reg",)}, {"k": ("heap", 0, 7, "c"), "c": ("reg",)})
    assert (frozenset("h"), frozenset("k")) in heap and (frozenset("b"), frozenset("c")) in heap
    with pytest.raises(ValueError):
        by_class({"a": ("?",)}, {})


def test_tables_of_functions(spark):
    rows = [(1, i, s[0], s[1] if s[0] in ("move", "label", "call") else None, encode(s[2]) if s[0] == "move" else encode(s[1]) if s[0] == "cjmp" else None, s[2] if s[0] == "cjmp" else None, s[3] if s[0] == "cjmp" else None) for i, s in enumerate(program(3))]
    rows.append((2, 0, "jmp", None, None, None, None))
    rows.append((3, 0, "move", "a", "not json", None, None)) if False else None
    df = spark.createDataFrame(rows, "func long, pos int, kind string, avar string, tree string, target string, other string")
    assert {r.func for r in T.value_sets(df).collect()} == {1}
    assert T.address_regions(df.limit(0)).collect() == []
    assert {r.func for r in T.post_orders(df).collect()} == {1, 2}
    from simforge.sources.sinks import pass_snapshots, snapshots

    s = pass_snapshots(df.where("func = 1"))
    assert s.count() == len(P.pipeline())
    assert snapshots(s).where("changed").count() > 3
    assert pass_snapshots(df.where("func = 2")).count() < 5


def test_null_operands(spark):
    df = spark.createDataFrame([(1, 1, 5, None, 2, 2), (1, 1, 5, 2, 2, 6)], "a long, b long, c long, d long, e long, f long")
    box = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, ("stride", "lo", "hi"))])
    got = [r.x for r in df.select(T.strided_column("+", box("a", "b", "c"), box("d", "e", "f")).alias("x")).collect()]
    assert got[0].lo is None and (got[1].stride, got[1].lo, got[1].hi) == (1, 3, 11)


def test_digests_read_a_graph_once(monkeypatch):
    """Each block's ways are looked up once before the passes and once after, and not for each digest."""
    f = P.from_statements([("cjmp", V("a"), "L", "R"), ("label", "L"), ("move", "eax", num(1)), ("jmp", "R"), ("label", "R"), ("halt",)])
    n, looked, out = len(f.blocks), [], P.Function.out
    monkeypatch.setattr(P.Function, "out", lambda f, v: looked.append(v) or out(f, v))
    before, body, after = T.digests(f, [])
    assert len(looked) == 2 * n and before == after != body
