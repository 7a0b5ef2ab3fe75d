"""Passes over memory, bits and phis: which bits of definitions matter, what calls leave undefined, named arrays for accesses at known places.

They take and change a Function, as those of passes.py do, and raise Confusing
where a function can't be analysed.
"""

from __future__ import annotations

from collections import defaultdict

from ..functions.strided import OPERATORS, Strided, constant, invert, neg, top, union
from .expressions import Tree, children, mapped, mask, memory_nodes, signed, used_bits, variables, walk, width
from .passes import ENTRY, ERROR, EXIT, SPECIAL, Confusing, Function, to_ssa
from .regions import region

#: What the default calling convention lets a call overwrite.
CALLER_SAVED = ("eax", "ecx", "edx")


def has_load(e) -> bool:
    return isinstance(e, tuple) and any(x[0] == "load" for x in memory_nodes(e))


def trim_definitions(f: Function) -> None:
    """A definition that its block replaces later keeps the bits that are used until then, low ones as a cast; one of which no bit is used goes. Repeated until nothing changes."""
    for b in f.blocks.values():
        changed = True
        while changed:
            changed = False
            for i, s in enumerate(b):
                if s[0] != "move" or s[2][0] in ("store", "phi") or any(x[0] == "call" for x in b[i + 1 :]):
                    continue
                end = next((k for k in range(i + 1, len(b)) if b[k][0] == "move" and b[k][1] == s[1]), None)
                if end is None:
                    continue
                bits = 0
                for x in b[i + 1 : end + 1]:
                    for e in x[1:]:
                        if isinstance(e, tuple):
                            bits |= used_bits(e).get(s[1], 0)
                w, low = width(s[2]), bits.bit_length()
                if not bits:
                    del b[i]
                elif low < w and not (s[2][0] == "cast" and s[2][1] == "unsigned" and width(s[2][3]) <= low):
                    b[i] = ("move", s[1], ("cast", "unsigned", w, ("cast", "low", low, s[2])))
                else:
                    continue
                changed = True
                break


def loads_ahead(f: Function) -> set[int]:
    """Blocks at whose end a load is still reachable."""
    own = {v for v, b in f.blocks.items() if any(e.__class__ is tuple and has_load(e) for s in b for e in s[1:])}
    out: set[int] = set()
    changed = True
    while changed:
        changed = False
        for s, d, _ in f.edges:
            if s not in out and (d in own or d in out):
                out.add(s)
                changed = True
    return out


def summarize_calls(f: Function, saved: tuple[str, ...] = CALLER_SAVED, memory: str = "mem") -> None:
    """After each call stand definitions of what it may have overwritten: the registers that callers save, as far as the function has them, and memory if a load is still to come."""
    names = {s[1] for *_, s in f.statements() if s[0] == "move"}.union(*[f.variables(e) for *_, s in f.statements() for e in s[1:] if isinstance(e, tuple)])
    ahead = loads_ahead(f)
    for v, b in f.blocks.items():
        out = []
        for i, s in enumerate(b):
            out.append(s)
            if s[0] != "call":
                continue
            lost = [r for r in saved if r in names]
            if memory in names and (v in ahead or any(has_load(e) for x in b[i + 1 :] for e in x[1:])):
                lost.append(memory)
            out += [("move", r, ("unknown", f"{r} after {s[1]}")) for r in lost]
        b[:] = out


def address_map(f: Function) -> None:
    """Which block each label stands in."""
    f.info["blocks"] = {s[1]: v for v, _, s in f.statements() if s[0] == "label"}


def remove_special(f: Function) -> None:
    for b in f.blocks.values():
        b[:] = [s for s in b if s[0] != "special"]


def coerce(f: Function) -> None:
    """The narrower side of an operation is padded to the width of the other."""

    def node(e: Tree) -> Tree:
        if e[0] == "bin" and e[1] not in ("<<", ">>", "s>>") and (a := width(e[2])) != (b := width(e[3])):
            w = max(a, b)
            pad = lambda x, n: x if n == w else ("int", x[1], w) if x[0] == "int" else ("cast", "unsigned", w, x)
            return ("bin", e[1], pad(e[2], a), pad(e[3], b))
        return e

    for b in f.blocks.values():
        b[:] = [tuple(mapped(x, node) if isinstance(x, tuple) else x for x in s) for s in b]


def propagate_phis(f: Function, rounds: int = 30) -> None:
    """A phi of phis takes their variables in, for some rounds at most; what is left after them stays as it is."""
    for _ in range(rounds):
        phis = {s[1]: s[2] for *_, s in f.statements() if s[0] == "move" and s[2][0] == "phi"}
        changed = False
        for b in f.blocks.values():
            for i, s in enumerate(b):
                if s[0] == "move" and s[2][0] == "phi":
                    args = {y for x in s[2][1:] for y in (phis[x[1]][1:] if x[1] in phis and x[1] != s[1] else (x,)) if y[1] != s[1]}
                    new = ("phi", *sorted(args))
                    if args and new != s[2]:
                        b[i], changed = ("move", s[1], new), True
        if not changed:
            return


def sink_partial(f: Function) -> None:
    """A definition that only one of its block's ways out needs moves onto that way: to the head of the next block, or to a new one on the edge. Loads, stores, phis and what is live at the end stay."""
    uses = defaultdict(set)
    for v, i, s in f.statements():
        for e in s[1:]:
            if isinstance(e, tuple):
                for x in variables(e):
                    uses[x].add((v, s[0] == "move" and s[2][0] == "phi"))
    for v in sorted(set(f.blocks) - SPECIAL):
        nexts = {d for _, d, _ in f.out(v)}
        if len(nexts) < 2:
            continue
        for s in reversed([x for x in f.blocks[v] if x[0] == "move"]):
            at = uses[s[1]]
            if len(at) != 1 or s[1] in f.info.get("liveout", ()) or s[2][0] in ("phi", "unknown") or any(x[0] in ("load", "store") for x in walk(s[2])):
                continue
            d, phi = next(iter(at))
            if d not in nexts or d == v or d in SPECIAL or len([e for e in f.out(v) if e[1] == d]) != 1:
                continue
            if not phi and len(f.into(d)) == 1:
                k = next((i for i, x in enumerate(f.blocks[d]) if not (x[0] == "label" or x[0] == "move" and x[2][0] == "phi")), len(f.blocks[d]))
                to = d
            elif phi:
                edge = next(e for e in f.out(v) if e[1] == d)
                to, k = max(f.blocks) + 1, 0
                f.blocks[to] = []
                f.edges = (f.edges - {edge}) | {(v, to, edge[2]), (to, d, None)}
                nexts = {x for _, x, _ in f.out(v)}
            else:
                continue
            f.blocks[v].remove(s)
            f.blocks[to].insert(k, s)
            for x in variables(s[2]):
                uses[x] = {(w, p) for w, p in uses[x] if w != v or any(x in variables(e) for y in f.blocks[v] for e in y[1:] if isinstance(e, tuple))} | {(to, False)}


# Arrays


def address(e: Tree, defs: dict[str, Tree], known: dict | None = None) -> tuple[str, float, float] | None:
    """(base, least, greatest) of an address: a register, plus or minus a constant; or a constant, whose base is nothing. known keeps the regions of variables, for further addresses under the same definitions."""
    known = {} if known is None else known

    def at(x: str) -> tuple[str, float, float] | None:
        if x not in known:
            known[x] = region(x, defs)
        return known[x]

    match e:
        case ("int", v, w):
            return "", signed(v, w), signed(v, w)
        case ("var", x, _):
            return at(x)
        case ("bin", "+", ("var", x, _), ("int", v, w)) | ("bin", "+", ("int", v, w), ("var", x, _)):
            k = signed(v, w)
        case ("bin", "-", ("var", x, _), ("int", v, w)):
            k = -signed(v, w)
        case _:
            return None
    r = at(x)
    return r and (r[0], r[1] + k, r[2] + k)


def accesses(f: Function, known: dict | None = None) -> list[tuple[str, int, int, Tree]]:
    """(base, first byte, last byte, address) of every load and store at a known place."""
    known = {} if known is None else known
    defs = {s[1]: s[2] for *_, s in f.statements() if s[0] == "move"}
    out = []
    for *_, s in f.statements():
        for e in s[1:]:
            if e.__class__ is tuple and e[0] not in ("unknown", "phi"):
                for x in memory_nodes(e):
                    if (r := address(x[2], defs, known)) and abs(r[1]) != float("inf") and abs(r[2]) != float("inf"):
                        out.append((r[0], int(r[1]), int(r[2]) + x[-1] // 8 - 1, x[2]))
    return out


def arrays(places: list[tuple[str, int, int, Tree]]) -> dict[tuple[str, Tree], str]:
    """Which array each address (base, tree) lies in: those of a base whose bytes overlap make one, named by base and bounds."""
    by_base = defaultdict(list)
    for base, lo, hi, e in places:
        by_base[base].append((lo, hi, e))
    out = {}
    for base, own in by_base.items():
        own.sort(key=lambda x: x[:2])
        at = 0
        while at < len(own):
            end, hi = at + 1, own[at][1]
            while end < len(own) and own[end][0] <= hi:
                hi = max(hi, own[end][1])
                end += 1
            for _, _, e in own[at:end]:
                out[base, e] = f"{base.split('.')[0] or 'global'}[{own[at][0]}:{hi}]"
            at = end
    return out


def name_arrays(f: Function, memory: str = "mem") -> None:
    """Loads and stores at known places go to arrays by name, in single assignment; what a call leaves of memory is unknown in every array."""
    defs = {s[1]: s[2] for *_, s in f.statements() if s[0] == "move"}
    known: dict = {}
    names = arrays(accesses(f, known))
    if not names:
        return

    def array_of(e: Tree) -> str | None:
        r = address(e, defs, known)
        return names.get((r[0], e)) if r else None

    def node(e: Tree) -> Tree:
        if e[0] == "load" and (a := array_of(e[2])):
            return ("load", ("var", a, 0), e[2], e[3])
        return e

    every = sorted(set(names.values()))
    for b in f.blocks.values():
        out = []
        for s in b:
            if s[-1].__class__ is tuple and memory_nodes(s[-1]):
                s = tuple(mapped(x, node) if isinstance(x, tuple) else x for x in s)
            if s[0] == "move" and s[2][0] == "store" and (a := array_of(s[2][2])):
                s = ("move", a, ("store", ("var", a, 0), *s[2][2:]))
            out.append(s)
            if s[0] == "move" and s[1].split(".")[0] == memory and s[2][0] == "unknown":
                out += [("move", a, ("unknown", f"{a} {s[2][1]}")) for a in every]
        b[:] = out
    to_ssa(f, set(every))
    f.info["arrays"] = every


def collapsible(f: Function) -> dict[tuple, Tree]:
    """(array version, address, width) of loads whose array was last defined by a store at the same place, with the stored value."""
    stores = {s[1]: s[2] for *_, s in f.statements() if s[0] == "move" and s[2][0] == "store"}
    return {(name, e[2], e[-1]): e[3] for name, e in stores.items()}


def find_collapsible(f: Function) -> None:
    known = collapsible(f)
    f.info["collapsible"] = sorted({x for *_, s in f.statements() for e in s[1:] if e.__class__ is tuple and e[0] not in ("unknown", "phi") for x in memory_nodes(e) if x[0] == "load" and x[1][0] == "var" and (x[1][1], x[2], x[-1]) in known}, key=repr)


def collapse_loads(f: Function) -> None:
    """Loads from where the last store to their array went become the value that it stored."""
    known = collapsible(f)
    node = lambda e: known.get((e[1][1], e[2], e[-1]), e) if e[0] == "load" and e[1][0] == "var" else e
    for b in f.blocks.values():
        b[:] = [tuple(mapped(x, node) if isinstance(x, tuple) else x for x in s) for s in b]


# Value sets


def value_sets(f: Function, rounds: int = 8) -> dict[str, Strided]:
    """A strided interval for each variable of a function in single assignment that holds all of its values. What still grows after some rounds is the whole width."""
    defs = {s[1]: s[2] for *_, s in f.statements() if s[0] == "move"}
    known: dict[str, Strided] = {}

    def of(e: Tree) -> Strided | None:
        """None: no value has come there yet."""
        match e:
            case ("int", v, w):
                return constant(v, w)
            case ("var", x, w):
                return known.get(x) if x in defs else top(w or 32)
            case ("bin", op, a, b) if op in OPERATORS:
                x, y = of(a), of(b)
                return None if x is None or y is None else OPERATORS[op](x, y) if x.width == y.width else top(width(e))
            case ("un", "-" | "~" as op, a):
                x = of(a)
                return x and (neg(x) if op == "-" else invert(x))
            case ("phi", *vs):
                found = [x for x in map(of, vs) if x is not None]
                out = found[0] if found else None
                for x in found[1:]:
                    out = union(out, x) if x.width == out.width else top(width(e))
                return out
        return top(width(e) or 32)

    for k in range(rounds + len(defs) + 1):
        changed = False
        for name, e in defs.items():
            new = of(e)
            if new is not None and new != known.get(name):
                known[name] = new if k < rounds else top(new.width)
                changed = True
        if not changed:
            return known
        if k >= rounds and all(v == top(v.width) or of(defs[n]) == v for n, v in known.items()):
            return known
    raise Confusing("values don't settle")


# Layout


def layout(f: Function) -> list[tuple]:
    """The statements of a graph in an order from which the graph can be built again: a block's plain successor follows it where that is still free, and is jumped to where not."""
    names = {v: f"b{v}" for v in f.blocks}
    out: list[tuple] = []
    done: set[int] = set()
    todo = [ENTRY]
    while todo:
        v = todo.pop()
        if v in done or v in (EXIT, ERROR):
            continue
        first = True
        while v is not None and v not in done:
            done.add(v)
            if v != ENTRY or f.into(v):
                out.append(("label", names[v]))
            body = f.blocks[v]
            edges = f.out(v)
            out += [s for s in body if s[0] not in ("jmp", "cjmp")]
            cond = body[-1] if body and body[-1][0] == "cjmp" else None
            nexts, v, first = [d for _, d, _ in edges], None, False
            if cond is not None and len(edges) == 2:
                yes, no = (next(d for _, d, label in edges if label is x) for x in (True, False))
                out.append(("cjmp", cond[1], names[yes], names[no]))
                todo += [no, yes]
            elif nexts:
                d = nexts[0]
                if d == EXIT:
                    if not body or body[-1][0] != "halt":
                        out.append(("jmp", names[EXIT]))
                elif d in done or d == ERROR:
                    out.append(("jmp", names[d]))
                else:
                    v = d
    return [*out, ("label", names[EXIT])]


def replace_by_error(f: Function, v: int) -> None:
    """Block v goes, and what led to it leads to the error block."""
    f.blocks.setdefault(ERROR, [])
    f.edges = {(s, ERROR if d == v else d, label) for s, d, label in f.edges if s != v}
    del f.blocks[v]


def exit_kinds(f: Function, register: str = "eax") -> dict[int, str]:
    """How each block before the exit ends: Returns (it defines the result), Calls, Empty, or Unidentified. Halts are those that RemoveHalts noted."""
    halts = f.info.get("halting", set())
    out = {}
    for v, _, _ in f.into(EXIT):
        b = f.blocks[v]
        if v in halts:
            out[v] = "Halts"
        elif b and b[-1][0] == "call":
            out[v] = "Calls"
        elif any(s[0] == "move" and s[1].split(".")[0] == register for s in b):
            out[v] = "Returns"
        else:
            out[v] = "Empty" if not b else "Unidentified"
    return out


def post_order(f: Function, start: int = ENTRY) -> list[int]:
    """Blocks after all that they lead to, along a depth-first walk."""
    out, seen, stack = [], {start}, [(start, iter(f.out(start)))]
    while stack:
        v, it = stack[-1]
        for _, d, _ in it:
            if d not in seen:
                seen.add(d)
                stack.append((d, iter(f.out(d))))
                break
        else:
            stack.pop()
            out.append(v)
    return out


def count_variables(e: Tree) -> int:
    """Variables under a value; of a choice, those of its condition alone. Loads and stores have no count."""
    if e[0] in ("load", "store"):
        raise Confusing(f"no count of variables under a {e[0]}")
    if e[0] == "var":
        return 1
    return sum(count_variables(e[i]) for i in (children(e)[:1] if e[0] == "ite" else children(e)))


def branch_flags(f: Function, v: int) -> set[str]:
    """The one-bit variables that the branch at a block's end depends on, by way of definitions in the block."""
    b = f.blocks[v]
    if not b or b[-1][0] != "cjmp":
        return set()
    defs = {s[1]: s[2] for s in b if s[0] == "move"}
    out, todo = set(), [b[-1][1]]
    while todo:
        for x in walk(todo.pop()):
            if x[0] == "var" and x[2] == 1 and x[1] not in out:
                out.add(x[1])
                if x[1] in defs:
                    todo.append(defs[x[1]])
    return out


def masked(e: Tree, bits: int) -> Tree:
    """e with only the given bits asked for."""
    return e if bits & mask(width(e)) == mask(width(e)) else ("bin", "&", e, ("int", bits, width(e)))
