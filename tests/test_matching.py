"""Matching of functions: terms, constants, and the way of correspondences over matched blocks."""

import itertools
import random

import pytest

from simforge.operators import expressions as X
from simforge.operators import matching as M


def var(name, w=32):
    return ("var", name, w)


def num(v, w=32):
    return ("int", v, w)


def bin_(op, a, b):
    return ("bin", op, a, b)


def pairs(text):
    return M.canonical(tuple(frozenset(x.split()) for x in p.split("=")) for p in text.split(";") if p)


# Terms


def test_order_of_operands():
    """(p + q) & (p - 1) against (x + y) & (y - 1), in every order."""
    left = bin_("&", bin_("+", var("p"), var("q")), bin_("-", var("p"), num(1)))
    for a, b in itertools.permutations(("x", "y")):
        for flip in (False, True):
            ops = [bin_("+", var(a), var(b)), bin_("-", var("y"), num(1))]
            assert M.equivalent(left, bin_("&", *(reversed(ops) if flip else ops))) == pairs("p=y;q=x")


def random_tree(r, depth, names):
    if not depth or r.random() < 0.2:
        return num(r.randrange(3)) if r.random() < 0.3 else var(r.choice(names))
    op = r.choice("+*&^-")
    return bin_(op, random_tree(r, depth - 1, names), random_tree(r, depth - 1, names))


def shuffled(r, e):
    """e with the operands of commutative operations in another order."""
    return X.mapped(e, lambda x: ("bin", x[1], x[3], x[2]) if x[0] == "bin" and x[1] in X.COMMUTATIVE and r.random() < 0.5 else x)


def renamed(e, names):
    return X.mapped(e, lambda x: ("var", names[x[1]], x[2]) if x[0] == "var" else x)


@pytest.mark.parametrize("seed", range(150))
def test_equivalence_whatever_the_order(seed):
    r = random.Random(seed)
    names = "abcd"
    e = random_tree(r, 4, names)
    other = renamed(e, dict(zip(names, "wxyz")))
    want = M.equivalent(e, other)
    assert want is not None
    for _ in range(4):
        a, b = shuffled(r, e), shuffled(r, other)
        assert M.fingerprint(a) == M.fingerprint(b)
        got = M.equivalent(a, b)
        # Which of several assignments is found may depend on order; that there is one doesn't.
        assert got is not None and all(len(p) == len(q) for p, q in got)
        true = dict(zip(names, "wxyz"))
        assert M.equivalent(a, b, [(frozenset([x]), frozenset([true[x]])) for x in sorted(X.variables(e))]) is not None


@pytest.mark.parametrize("seed", range(60))
def test_no_false_equivalence(seed):
    """Against trying every renaming of names and every order of operands, on small trees with two names."""
    r = random.Random(seed)
    a, b = random_tree(r, 2, "pq"), random_tree(r, 2, "xy")

    def flat(e):
        if e[0] != "bin":
            return e
        if e[1] not in X.COMMUTATIVE:
            return ("bin", e[1], flat(e[2]), flat(e[3]))
        out, todo = [], [e]
        while todo:
            for x in todo.pop()[2:]:
                todo.append(x) if x[0] == "bin" and x[1] == e[1] else out.append(flat(x))
        return ("bag", e[1], tuple(sorted(out, key=repr)))

    want = any(flat(renamed(a, dict(zip("pq", to)))) == flat(b) for to in itertools.permutations("xy"))
    assert (M.equivalent(a, b) is not None) == want
    assert M.fingerprint(a) == M.fingerprint(b) or not want


@pytest.mark.parametrize(
    "a, b, want",
    [
        (num(5), ("store", var("mem", 0), num(8), num(5), 32), ""),
        (("store", var("mem", 0), num(8), num(5), 32), ("store", var("m2", 0), num(16), num(5), 32), ""),
        (("phi", var("a.1"), var("a.2")), ("load", ("phi", var("s.1", 0), var("s.2", 0)), num(0), 32), "a.1 a.2=s.1 s.2"),
        (var("eax"), ("load", var("esp[4:7].0", 0), num(0), 32), "eax=esp[4:7].0"),
        (bin_("+", var("eax"), num(1)), bin_("+", num(1), ("load", var("esp[4:7]", 0), num(0), 32)), "eax=esp[4:7]"),
        (bin_("+", var("p"), var("p")), bin_("+", var("x"), var("x")), "p=x"),
        (bin_("+", bin_("+", var("p"), var("p")), var("q")), bin_("+", var("x"), bin_("+", var("y"), var("y"))), "p=y;q=x"),
    ],
)
def test_terms_of_different_kinds(a, b, want):
    assert M.equivalent(a, b) == pairs(want) and M.equivalent(b, a) == M.canonical((q, p) for p, q in pairs(want))
    assert M.fingerprint(a) == M.fingerprint(b)


@pytest.mark.parametrize(
    "a, b",
    [
        (num(5), ("store", var("mem", 0), num(8), num(6), 32)),
        (num(5), num(5, 8)),
        (var("eax"), ("load", var("esp[-4:-1]", 0), num(0), 32)),
        (var("eax"), ("load", var("esp[4:11]", 0), num(0), 32)),
        (("phi", var("a"), var("b")), ("phi", var("x"), var("y"), var("z"))),
        (("unknown", "u"), ("unknown", "u")),
        (bin_("+", var("p"), var("p")), bin_("+", var("x"), var("y"))),
        (bin_("-", var("p"), num(1)), bin_("-", num(1), var("p"))),
    ],
)
def test_terms_that_differ(a, b):
    assert M.equivalent(a, b) is None and M.equivalent(b, a) is None


def test_deep_trees():
    deep = lambda name, op, n=5000: __import__("functools").reduce(lambda e, i: bin_(op, e, num(i)) if op == "-" else bin_(op, var(f"{name}{i}"), e), range(n), var(name))
    assert M.equivalent(deep("a", "-"), deep("b", "-")) == pairs("a=b")
    assert len(M.equivalent(deep("a", "+", 300), deep("b", "+", 300))) == 1
    assert X.decode(X.encode(("un", "-", ("un", "-", var("a"))))) == ("un", "-", ("un", "-", var("a")))


# Outputs


@pytest.mark.parametrize("seed", range(40))
def test_fingerprints_pair_what_a_nested_loop_pairs(seed):
    r = random.Random(seed)
    trees = [random_tree(r, 2, "abc") for _ in range(6)]
    left = {f"o{i}": e for i, e in enumerate(trees)}
    right = {f"p{i}": renamed(shuffled(r, r.choice(trees)), dict(zip("abc", "xyz"))) for i in range(6)}
    known, want = [], []
    free = sorted(right)
    for x in sorted(left):
        for y in free:
            got = M.equivalent(left[x], right[y], known)
            if got is not None:
                want.append((x, y))
                free.remove(y)
                known = got
                break
    got, also, compared = M.pair_outputs(left, right)
    assert (got, also) == (want, known)
    assert compared <= 36 and (compared < 36 or len({M.fingerprint(e) for e in [*left.values(), *right.values()]}) == 1)


def test_constants_are_paired_by_value_whatever_their_order():
    left = {"a": num(7), "b": bin_("+", num(3), num(4)), "c": num(1), "d": num(2)}
    right = {"p": bin_("-", num(9), num(2)), "q": num(7), "r": num(1), "s": num(1)}
    answers = set()
    for names in itertools.permutations("pqrs"):
        pairings, n, ours, theirs = M.pair_constants(left, {m: right[k] for m, k in zip(names, "pqrs")})
        back = dict(zip(names, "pqrs"))
        answers.add((tuple((tuple(sorted(a)), tuple(sorted(back[x] for x in b))) for a, b in pairings), n, len(ours), len(theirs)))
    assert answers == {(((("a", "b"), ("p", "q")),), 3, 4, 4)}
    m = M.compare_blocks({"a": num(7), "x": var("v")}, {"y": var("w"), "b": bin_("*", num(7), num(1))})
    assert m.kind == "Exact" and set(m.outs) == set(pairs("a=b;x=y")) and m.ins == tuple(pairs("v=w"))
    assert M.constant_value(bin_("/", num(1), num(0))) is None and M.constant_value(var("x")) is None


# Functions


def test_a_conflict_elsewhere_keeps_a_block_out():
    """The last block matches by itself, but takes from the first what that puts out under another name."""
    left = {"blocks": {-4: {"s": bin_("+", var("a"), num(1)), "t": bin_("-", var("a"), num(1))}, 1: {"u": bin_("*", var("b"), num(3))}, 2: {"w": bin_("-", var("s"), num(5))}}, "edges": [(-4, 1, None), (1, 2, None)]}
    names = {"a": "x", "b": "y", "s": "p", "t": "q", "u": "z", "w": "e"}
    right = {"blocks": {k: {names[o]: renamed(e, names) for o, e in outs.items()} for k, outs in left["blocks"].items()}, "edges": left["edges"]}
    good = M.match_functions(left, right)
    assert (good["fuzz"], good["overlap"], good["edges"]) == ("ExactOnly", "Total", [(-4, 1, None), (1, 2, None)])
    assert pairs("s=p") == [p for p in good["parts"][2][1] if "s" in p[0]]
    right["blocks"][2] = {"e": bin_("-", var("q"), num(5))}
    assert M.compare_blocks(left["blocks"][2], right["blocks"][2]).kind == "Exact"
    bad = M.match_functions(left, right)
    assert [p[0] for p in bad["pairs"]] == [-4, 1]
    # Where none of the names is of use in between, nothing tells.
    for side, n in ((left, "ab"), (right, "xy")):
        side["seen"] = {1: set(n), 2: set(n), -4: set(n)}
    assert M.match_functions(left, right)["n"] == 3


def test_loops_and_self_loops():
    edges = [(-4, 1, None), (1, 1, True), (1, 2, False), (2, 1, None)]
    left = {"blocks": {k: {f"o{k}": bin_("+", var(f"i{k}"), num(abs(k)))} for k in (-4, 1, 2)}, "edges": edges}
    m = M.match_functions(left, left)
    assert m["n"] == 3 and sorted(m["edges"], key=str) == sorted(edges, key=str)


def test_long_functions_end():
    n = 10_050
    side = {"blocks": {(-4 if k == 0 else k): {"o": bin_("+", var("i"), num(k))} for k in range(n)}, "edges": [(-4 if k == 0 else k, k + 1, None) for k in range(n - 1)]}
    m = M.match_functions(side, side)
    assert (m["fuzz"], m["overlap"], m["n"]) == ("ExactOnly", "Total", n)


def random_pair(r, blocks=7):
    """A function with branches, and a copy whose names differ and in which something may have changed."""
    ids = [-4, *range(1, blocks)]
    names = [f"v{i}" for i in range(5)]
    body = {k: {f"o{k}.{j}": random_tree(r, 2, names + [f"o{p}.0" for p in ids[: ids.index(k)]]) for j in range(r.randrange(1, 3))} for k in ids}
    edges = set()
    for i, k in enumerate(ids[:-1]):
        if r.random() < 0.5:
            edges |= {(k, ids[i + 1], False), (k, r.choice(ids), True)}
        else:
            edges.add((k, ids[i + 1], None))
    every = {o for outs in body.values() for o in outs} | set(names)
    to = {x: f"{x}'" for x in every}
    other = {k: {to[o]: renamed(shuffled(r, e), to) for o, e in outs.items()} for k, outs in body.items()}
    k = r.choice(ids)
    change = r.randrange(6)
    if change == 1:
        other[k]["new"] = num(99)
    elif change == 2:
        other[k].popitem()
    elif change == 3:
        swap = dict.fromkeys(to.values()) | {x: x for x in to.values()} | {"v0'": "v1'", "v1'": "v0'"}
        other[k] = {o: renamed(e, swap) for o, e in other[k].items()}
    elif change == 5:
        other[-4][min(other[-4])] = ("un", "-", var("v0'"))
    elif change == 4:
        edges_right = {(s, d, (None if x is None else not x) if s == k else x) for s, d, x in edges}
        return {"blocks": body, "edges": sorted(edges, key=str)}, {"blocks": other, "edges": sorted(edges_right, key=str)}
    return {"blocks": body, "edges": sorted(edges, key=str)}, {"blocks": other, "edges": sorted(edges, key=str)}


def flowed(own, edges, backward):
    """Pairings at each block by plain repetition."""
    at = {x: set(ps) for x, ps in own.items()}
    while True:
        new = {x: set(ps) for x, ps in at.items()}
        for s, d, _ in edges:
            a, b = (d, s) if backward else (s, d)
            new[b] |= at[a]
        if new == at:
            return at
        at = new


def agrees(*lists):
    """Whether names in the same pairings are as many on both sides, by listing every name's pairings."""
    every = [p for ps in lists for p in ps]
    count = {}
    for side in (0, 1):
        for name in {n for p in every for n in p[side]}:
            key = tuple(name in p[side] for p in every)
            count.setdefault(key, [0, 0])[side] += 1
    return all(a == b for a, b in count.values())


def along(outs, ins):
    return not [1 for o in outs for i in ins if len(o[0] & i[0]) != len(o[1] & i[1])]


@pytest.mark.parametrize("seed", range(120))
def test_fragments_by_definition(seed):
    """A fragment is connected, free of conflicts after plain repetition, and what could still be added isn't."""
    left, right = random_pair(random.Random(seed))
    m = M.match_functions(left, right)
    at = {p[0]: p[1] for p in m["pairs"]}
    if not at:
        return
    compared = {x: M.compare_blocks(left["blocks"][x], right["blocks"][y]) for x, y in at.items()}
    ins = flowed({x: c.ins for x, c in compared.items()}, m["edges"], True)
    outs = flowed({x: c.outs for x, c in compared.items()}, m["edges"], False)
    for x in at:
        assert agrees(ins[x]) and agrees(outs[x])
        for flow, got in zip((ins, outs), m["parts"][x]):
            assert M.canonical(M.merge(sorted(flow[x], key=str), [])) == got
    for s, d, label in m["edges"]:
        assert (s, d, label) in left["edges"] and (at[s], at[d], label) in right["edges"]
    reached, todo = {-4}, [-4]
    while todo:
        v = todo.pop()
        for s, d, _ in m["edges"]:
            for a, b in ((s, d), (d, s)):
                if a == v and b not in reached:
                    reached.add(b)
                    todo.append(b)
    assert reached == set(at)


def test_propagation_matters():
    """Some pairs of the random test lose blocks by conflicts alone, and all kinds of blocks occur."""
    kinds, lost = set(), 0
    for seed in range(120):
        left, right = random_pair(random.Random(seed))
        for policy in ("whole-function", "fuzzy-inline"):
            m = M.match_functions(left, right, policy)
            kinds |= {p[2] for p in m["pairs"]}
        free = {"blocks": left["blocks"], "edges": left["edges"], "seen": {}}
        lost += M.match_functions(free, {**right, "seen": {}})["n"] > M.match_functions(left, right)["n"]
    assert kinds == {"Exact", "Subset", "Superset", "Partial"} and lost > 0


def test_pairings_are_sent_on_only_where_they_can_conflict(monkeypatch):
    """A chain whose pairings all hold at once is matched without sending any on; blocks that are alike are compared once, whatever function they are in."""
    n = 40
    blocks = lambda s: {-4 if k == 1 else k: {f"{s}{k}": f'["bin","+",["var","{s}{k - 1}",32],["int",1,32]]'} for k in range(1, n + 1)}
    ids = sorted(blocks("x"))
    compared, sent = [], []
    whole, settle = M.compare_blocks, M.Fragment.settle
    monkeypatch.setattr(M, "compare_blocks", lambda *a: compared.append(1) or whole(*a))
    monkeypatch.setattr(M.Fragment, "settle", lambda *a: sent.append(1) or settle(*a))
    memo = M.Memo()
    for _ in range(3):
        left, right = ({"blocks": blocks(s), "edges": [(a, b, None) for a, b in zip(ids, ids[1:])], "memo": memo} for s in "xy")
        m = M.match_functions(left, right, pairings=False)
        assert (m["n"], m["fuzz"], m["overlap"], m["parts"]) == (n, "ExactOnly", "Total", {})
    assert len(compared) == n and not sent
    # A last block that takes another name is in conflict, and is found to be by its own pairings.
    right["blocks"][n] = {f"y{n}": f'["bin","+",["var","y{n - 2}",32],["int",1,32]]'}
    assert M.match_functions(left, right, pairings=False)["n"] == n - 1 and len(sent) < 5
    assert len(M.match_functions(left, right)["parts"][-4][0]) == n - 1
