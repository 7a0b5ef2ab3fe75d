from simforge.operators import passes as P
from simforge.operators.expressions import encode

A, B = ("var", "a", 32), ("var", "b", 32)
num = lambda v: ("int", v, 32)
add = lambda x, y: ("bin", "+", x, y)
ZERO = ("bin", "==", A, num(0))


def diamond(cond=ZERO, arms=("L", "R")):
    return [("cjmp", cond, *arms), ("label", "L"), ("move", "eax", add(A, num(1))), ("jmp", "E"), ("label", "R"), ("move", "eax", add(A, num(2))), ("label", "E"), ("move", "x", add(("var", "eax", 32), B)), ("move", "eax", ("var", "x", 32))]


def kinds(f):
    return sorted(s[0] for *_, s in f.statements())


def test_graph_of_statements():
    f = P.from_statements(diamond())
    assert f.edges == {(-4, 0, None), (0, 1, True), (0, 2, False), (1, 3, None), (2, 3, None), (3, -3, None)}
    f = P.from_statements([("jmp", None), ("label", "dead"), ("jmp", "nowhere")])
    assert (0, -2, None) in f.edges and (1, -1, None) in f.edges
    P.prune(f)
    assert set(f.blocks) == {-4, -3, -2, 0}


def test_empty_function():
    f, why = P.run_passes(P.from_statements([]))
    assert why is None and f.edges == {(-4, -3, None)}


def test_confusing_is_tagged():
    assert P.run_passes(P.from_statements([("jmp", None)]))[1] == "CollectCalls: indirect jump"
    f = P.from_statements([("jmp", "nowhere")])
    assert P.run_passes(f)[1].startswith("RemoveIndirect")


def test_pipeline_normalizes():
    f, why = P.run_passes(P.from_statements(diamond()))
    assert why is None
    moves = {s[1]: s[2] for *_, s in f.statements() if s[0] == "move"}
    assert [x for x in f.info["liveout"]] and all(v in moves for v in f.info["liveout"])
    assert any(e[0] == "phi" for e in moves.values())
    negated, _ = P.run_passes(P.from_statements(diamond(("un", "~", ZERO), ("R", "L"))))
    assert sorted(map(repr, f.edges)) == sorted(map(repr, negated.edges)) and kinds(f) == kinds(negated)


def test_calls_break_blocks_and_noreturn_ends_them():
    f = P.from_statements([("move", "a", num(1)), ("call", "f"), ("move", "b", num(2)), ("call", "abort"), ("move", "c", num(3))])
    P.break_after_calls(f)
    assert [len(f.blocks[v]) for v in sorted(set(f.blocks) - P.SPECIAL)] == [2, 2, 1]
    P.remove_noreturn_edges(f)
    assert not any(s[0] == "move" and s[1] == "c" for *_, s in f.statements())


def test_single_exit_takes_the_common_end():
    end = ("move", "eax", num(7))
    f = P.from_statements([("cjmp", ZERO, "L", "R"), ("label", "L"), ("move", "x", num(1)), end, ("halt",), ("label", "R"), ("move", "x", num(2)), end, ("halt",)])
    P.remove_halts(f)
    P.force_single_exit(f)
    assert len(f.into(P.EXIT)) == 1 and f.blocks[f.into(P.EXIT)[0][0]] == [end]


def test_loops_keep_their_value():
    loop = [("move", "i", num(0)), ("label", "H"), ("cjmp", ("bin", "==", ("var", "i", 32), A), "X", "B"), ("label", "B"), ("move", "i", add(("var", "i", 32), num(1))), ("jmp", "H"), ("label", "X"), ("move", "eax", ("var", "i", 32))]
    f, why = P.run_passes(P.from_statements(loop))
    assert why is None and sum(s[0] == "move" and s[2][0] == "phi" for *_, s in f.statements()) == 1


def test_table(spark):
    rows = []
    for pos, s in enumerate(diamond()):
        tree = encode(s[-1] if s[0] == "move" else s[1]) if s[0] in ("move", "cjmp") else None
        rows.append((1, pos, s[0], s[1] if s[0] in ("move", "label") else None, tree, s[2] if s[0] == "cjmp" else s[1] if s[0] == "jmp" else None, s[3] if s[0] == "cjmp" else None))
    rows.append((2, 0, "jmp", None, None, None, None))
    df = spark.createDataFrame(rows, "func long, pos int, kind string, avar string, tree string, target string, other string")
    out = P.normalized(df).collect()
    assert [r.reason for r in out if r.func == 2] == ["CollectCalls: indirect jump"]
    assert all(r.reason is None and r.kind for r in out if r.func == 1)


def test_work_of_simplify_and_regions_is_bounded(monkeypatch):
    """A chain of copies takes as many rounds as it is long, but trees that have settled aren't rewritten in each; a variable's region is worked out once for all addresses on it."""
    from simforge.operators import memory_passes as MP

    n, calls, regions = 60, [], []
    normal, region = P.normal, MP.region
    monkeypatch.setattr(P, "normal", lambda e: calls.append(1) or normal(e))
    monkeypatch.setattr(MP, "region", lambda *a: regions.append(1) or region(*a))
    v = lambda x: ("var", x, 32)
    chain = [("move", "a0", ("bin", "+", v("p"), ("int", 1, 32))), *(("move", f"b{i}", ("bin", "*", v("p"), v("q"))) for i in range(n))]
    copies = [("move", f"c{i}", v(f"c{i - 1}" if i else "p")) for i in reversed(range(n))]
    f = P.Function({P.ENTRY: [*chain, *copies], P.EXIT: []}, {(P.ENTRY, P.EXIT, None)})
    P.simplify(f)
    assert {s[2] for s in f.blocks[P.ENTRY] if s[1].startswith("c")} == {v("p")}
    assert len(calls) < 8 * n
    loads = [("move", f"d{i}", ("load", v("mem"), ("bin", "+", v("p"), ("int", 4 * i, 32)), 32)) for i in range(n)]
    assert len(MP.accesses(P.Function({P.ENTRY: loads}, set()))) == n and len(regions) == 1


def test_edges_by_their_ends():
    """Edges know their ends after any change, as a search of all of them finds."""
    import random

    r = random.Random(5)
    f = P.Function({v: [] for v in range(6)})
    for _ in range(600):
        some = {(r.randrange(6), r.randrange(6), r.choice([None, True, False])) for _ in range(r.randrange(4))}
        match r.randrange(6):
            case 0:
                f.edges |= some
            case 1:
                f.edges -= some
            case 2:
                f.edges = f.edges | some
            case 3:
                f.edges.update(some)
            case 4:
                f.edges.difference_update(some)
            case 5:
                for e in some:
                    f.edges.add(e)
        for v in range(6):
            assert {e for e in f.edges if e[0] == v} == set(f.out(v)) and {e for e in f.edges if e[1] == v} == set(f.into(v))
            assert len(f.out(v)) == len(set(f.out(v)))


def test_coalesce_is_as_from_the_start_each_time():
    """Joining the first blocks that can be joined, again and again, gives the same."""
    import random

    def plain(f, keep_calls):
        for v in sorted(set(f.blocks) - P.SPECIAL):
            out = [e for e in f.edges if e[0] == v]
            d = out[0][1] if len(out) == 1 else v
            if d == v or d in P.SPECIAL or len([e for e in f.edges if e[1] == d]) != 1 or keep_calls and f.blocks[v] and f.blocks[v][-1][0] == "call":
                continue
            f.blocks[v] = (f.blocks[v][:-1] if f.blocks[v] and f.blocks[v][-1][0] == "jmp" else f.blocks[v]) + f.blocks.pop(d)
            f.edges = {(v if s == d else s, x, label) for s, x, label in f.edges if x != d}
            return plain(f, keep_calls)

    r = random.Random(7)
    for _ in range(400):
        n = r.randrange(1, 9)
        blocks = {v: [("label", f"b{v}"), *[("call", "g")] * r.randrange(2), *[("jmp",)] * r.randrange(2)] for v in range(n)} | {P.ENTRY: [], P.EXIT: []}
        edges = {(P.ENTRY, 0, None)} | {(v, r.choice([*range(n), P.EXIT]), None if k == 0 else bool(k - 1)) for v in range(n) for k in r.choice([(0,), (0,), (0,), (1, 2), ()])}
        for keep in (False, True):
            f, g = (P.Function({v: list(b) for v, b in blocks.items()}, set(edges)) for _ in range(2))
            P.coalesce(f, keep)
            plain(g, keep)
            assert f.blocks == g.blocks and f.edges == g.edges


def test_trees_in_normal_form_are_not_rewritten_again(monkeypatch):
    """What one pass of rewriting has settled, the next leaves alone."""
    add = lambda x: ("bin", "+", ("var", x, 32), ("int", 1, 32))
    f = P.Function({P.ENTRY: [("move", f"v{i + 1}", add(f"v{i}")) for i in range(50)], P.EXIT: []}, {(P.ENTRY, P.EXIT, None)})
    rewritten = []
    normal = P.normal
    monkeypatch.setattr(P, "normal", lambda e: rewritten.append(e) or normal(e))
    P.simplify(f)
    P.simplify(f)
    assert len(rewritten) == 50


def test_region_at_the_end_of_very_many_ways():
    """Sixty choices one after another are 2 ** 60 ways to one sink."""
    from simforge.operators.regions import region

    defs, n = {}, 60
    for i in range(n):
        for name, k in (("a", 1), ("b", 2)):
            defs[f"{name}{i}"] = ("bin", "+", ("var", f"v{i}", 32), ("int", k, 32))
        defs[f"v{i + 1}"] = ("phi", ("var", f"a{i}", 32), ("var", f"b{i}", 32))
    assert region(f"v{n}", defs) == ("v0", n, 2 * n)
