"""Memory regions and effects of functions: sinks of addresses, offsets along them, stack heights, pointers, kills."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from .expressions import Tree, signed, walk
from .graphs import elementary_cycles, path_bounds


def cycle_signs(edges: list[tuple]) -> tuple[bool, bool]:
    """Whether some cycle has a negative sum of low bounds, and one a positive sum of high bounds. edges: (src, dst, low, high)."""
    succ, bounds = defaultdict(list), {}
    for s, d, lo, hi in edges:
        succ[s].append((0, d))
        old = bounds.get((s, d), (lo, hi))
        bounds[s, d] = min(old[0], lo), max(old[1], hi)
    negative = positive = False
    for c in elementary_cycles(succ, sorted({v for e in edges for v in e[:2]})):
        steps = [bounds[a, b] for a, b in zip(c, c[1:] + c[:1])]
        negative |= sum(lo for lo, _ in steps) < 0
        positive |= sum(hi for _, hi in steps) > 0
    return negative, positive


def offsets(edges: list[tuple], source) -> dict:
    """Vertex to (least, greatest) offset from source; an end is infinite where a cycle on the way keeps moving it."""
    low = path_bounds([(s, d, lo) for s, d, lo, _ in edges], source)
    high = path_bounds([(s, d, hi) for s, d, _, hi in edges], source, longest=True)
    return {v: (low[v], high[v]) for v in low}


def steps(name: str, e: Tree) -> list[tuple[str, int]]:
    """(variable, constant) of what a definition adds a constant to: a copy, plus or minus a constant, or a phi."""
    match e:
        case ("var", x, _):
            return [(x, 0)]
        case ("bin", "+", ("var", x, _), ("int", v, w)) | ("bin", "+", ("int", v, w), ("var", x, _)):
            return [(x, signed(v, w))]
        case ("bin", "-", ("var", x, _), ("int", v, w)):
            return [(x, -signed(v, w))]
        case ("phi", *vs):
            return [(v[1], 0) for v in vs]
    return []


def sinks(name: str, defs: dict[str, Tree]) -> dict[str, list[list[str]]]:
    """The inputs and loads that a variable's definitions lead back to, each with the ways there; a way doesn't enter a variable twice."""
    out: dict[str, list[list[str]]] = {}
    todo = [[name]]
    while todo:
        path = todo.pop()
        at = path[-1]
        e = defs.get(at)
        nexts = steps(at, e) if e is not None else []
        if e is None or e[0] == "load":
            out.setdefault(at, []).append(path)
        else:
            todo += [[*path, x] for x, _ in nexts if x not in path]
    return out


def region(name: str, defs: dict[str, Tree]) -> tuple[str, float, float] | None:
    """(base, least, greatest offset) if a variable has one sink. Cycles on the way, such as a counter's, open an end."""
    # The ways to sinks can be very many, and only their ends count here.
    found, seen, edges, todo = set(), set(), [], [name]
    while todo:
        x = todo.pop()
        if x in seen or x in found:
            continue
        e = defs.get(x)
        if e is None or e[0] == "load":
            found.add(x)
            continue
        seen.add(x)
        for y, k in steps(x, e):
            edges.append((x, y, k, k))
            todo.append(y)
    if len(found) != 1:
        return None
    base = found.pop()
    lo, hi = offsets(edges, name).get(base, (0, 0)) if edges else (0, 0)
    return base, lo, hi


def stack_heights(edges: list[tuple], deltas: dict, entry=-4, start: int = 0) -> dict:
    """Height before each vertex; None where ways disagree or a delta on the way isn't known. deltas: vertex to what it adds, or None."""
    out = defaultdict(list)
    for s, d, *_ in edges:
        out[s].append(d)
    height, todo = {entry: start}, [entry]
    while todo:
        v = todo.pop()
        delta = deltas.get(v, 0)
        after = None if height[v] is None or delta is None else height[v] + delta
        for d in out[v]:
            new = after if d not in height or height[d] == after else None
            if d not in height or height[d] != new:
                height[d] = new
                todo.append(d)
    return height


def well_behaved(heights: dict, exits) -> bool:
    """Whether all exits have one known height of 4 at most."""
    found = {heights.get(v) for v in exits}
    return len(found) == 1 and None not in found and max(found) <= 4


def pointers(defs: dict[str, Tree]) -> set[str]:
    """Variables that are used as an address, and those whose sums or differences with others are; a phi is one only if all of its variables are."""
    used = {y[1] for e in defs.values() for x in walk(e) if x[0] in ("load", "store") for y in walk(x[2]) if y[0] == "var"}
    changed = True
    while changed:
        changed = False
        for name, e in defs.items():
            new = set()
            if name in used and e[0] in ("var", "bin") and (e[0] == "var" or e[1] in "+-"):
                new = {x[1] for x in walk(e) if x[0] == "var"}
            if e[0] == "phi" and all(x[1] in used for x in e[1:]):
                new = {name}
            if not new <= used:
                used |= new
                changed = True
    return used


@dataclass(frozen=True)
class Kill:
    """What a call may overwrite: a reg by name, a stack or global interval, all registers or all memory. control: only on some ways through."""

    kind: str
    name: str = ""
    lo: int = 0
    hi: int = 0
    control: bool = False


def minimal(kills) -> frozenset[Kill]:
    """Without those that a catch-all covers."""
    every = {k.kind for k in kills}
    return frozenset(k for k in kills if not (k.kind == "reg" and "all_regs" in every or k.kind in ("stack", "global") and "all_memory" in every))


def join_kills(*summaries) -> frozenset[Kill]:
    """On one way after another."""
    return minimal({k for s in summaries for k in s})


def merge_kills(a, b) -> frozenset[Kill]:
    """On one way or the other: what only one of them has becomes dependent on control."""
    return minimal({k if k in b and k in a else Kill(k.kind, k.name, k.lo, k.hi, True) for k in {*a, *b}})


def summaries(calls: list[tuple[str, str]], own: dict[str, frozenset]) -> dict[str, frozenset[Kill]]:
    """Each function's kills with those of the functions it calls, until nothing changes."""
    out = {f: minimal(k) for f, k in own.items()}
    changed = True
    while changed:
        changed = False
        for a, b in calls:
            new = join_kills(out.get(a, frozenset()), out.get(b, frozenset([Kill("all_regs"), Kill("all_memory")])))
            if new != out.get(a):
                out[a], changed = new, True
    return out
