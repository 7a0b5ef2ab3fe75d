from simforge.operators.regions import Kill, cycle_signs, join_kills, merge_kills, offsets, pointers, region, sinks, stack_heights, summaries, well_behaved

V = lambda n: ("var", n, 32)
N = lambda v: ("int", v % 2**32, 32)


def test_cycles():
    assert cycle_signs([("a", "b", -2, 1), ("b", "a", 1, 1)]) == (True, True)
    assert cycle_signs([("a", "b", 1, -1), ("b", "a", 1, 0)]) == (False, False)
    assert cycle_signs([("a", "b", -5, 5)]) == (False, False)
    assert offsets([("a", "b", 1, 3), ("b", "b", 0, 4)], "a") == {"a": (0, 0), "b": (1, float("inf"))}


def test_sinks_and_regions():
    defs = {"p": ("bin", "+", V("base"), N(8)), "q": ("bin", "-", V("p"), N(4)), "l": ("load", V("mem"), V("q"), 32), "r": ("phi", V("q"), V("l")), "i": ("phi", V("base"), V("j")), "j": ("bin", "+", V("i"), N(4))}
    assert set(sinks("q", defs)) == {"base"} and set(sinks("r", defs)) == {"base", "l"}
    assert region("q", defs) == ("base", 4, 4) and region("r", defs) is None
    assert region("i", defs) == ("base", 0, float("inf"))
    assert {"q", "p", "base"} <= pointers(defs)


def test_heights():
    e = [(-4, 0), (0, 1), (0, 2), (1, 3), (2, 3)]
    assert stack_heights(e, {0: -4, 1: 4, 2: 4})[3] == 0
    assert stack_heights(e, {0: -4, 1: 4, 2: 8})[3] is None
    assert stack_heights(e, {0: None})[3] is None
    assert stack_heights([(-4, 0), (0, 0)], {0: 4})[0] is None
    assert well_behaved({3: 4}, [3]) and not well_behaved({3: 8}, [3]) and not well_behaved({3: None}, [3])


def test_kills():
    a, b = Kill("reg", "eax"), Kill("stack", "", 0, 4)
    assert join_kills({a}, {Kill("all_regs")}) == {Kill("all_regs")}
    assert merge_kills({a, b}, {a}) == {a, Kill("stack", "", 0, 4, True)}
    assert Kill("stack", "", 0, 4) != Kill("stack", "", 0, 8)
    got = summaries([("f", "g"), ("g", "f"), ("h", "unknown")], {"f": frozenset([a]), "g": frozenset([b]), "h": frozenset([a])})
    assert got["f"] == got["g"] == {a, b} and Kill("all_memory") in got["h"] and a not in got["h"]
