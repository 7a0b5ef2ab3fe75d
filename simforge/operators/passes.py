"""Passes over the control-flow graphs of functions, in a fixed order.

A function is blocks (id to statements) and edges (src, dst, label). Ids -4, -3,
-2 and -1 are entry, exit, indirect and error. Statements are tuples: ("move",
name, tree), ("label", name), ("jmp",), ("cjmp", tree), ("halt",), ("call",
target), ("comment", text). Each function is one call; one that a pass finds
confusing is tagged with the reason and left out, and never fails the job.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .expressions import Decoded, Tree, encode, memory_nodes, normal, substitute, variables, with_variables
from .graphs import immediate_dominators

ENTRY, EXIT, INDIRECT, ERROR = -4, -3, -2, -1
SPECIAL = {ENTRY, EXIT, INDIRECT, ERROR}
CODE = ("move", "cjmp", "jmp", "halt", "call")


class Confusing(Exception):
    """Why a function can't be analysed."""


class Edges(set):
    """Edges (src, dst, label) that know which of them leave a block and which enter it. A change by one edge costs the same however many there are."""

    _ends = None

    def at(self, end: int, v: int) -> dict[tuple, None]:
        """The edges that leave v (end 0) or enter it (end 1)."""
        if self._ends is None:
            self._ends = {}, {}
            for e in self:
                self._note(e)
        return self._ends[end].get(v, {})

    def _note(self, e: tuple) -> None:
        for end, by in enumerate(self._ends):
            by.setdefault(e[end], {})[e] = None

    def add(self, e: tuple) -> None:
        if self._ends is not None and e not in self:
            self._note(e)
        super().add(e)

    def discard(self, e: tuple) -> None:
        if self._ends is not None and e in self:
            for end, by in enumerate(self._ends):
                del by[e[end]][e]
        super().discard(e)

    def __ior__(self, other):
        for e in other:
            self.add(e)
        return self

    def __isub__(self, other):
        for e in list(other):
            self.discard(e)
        return self


def _unknown_ends(name: str):
    def run(self, *args):
        self._ends = None
        return getattr(set, name)(self, *args)

    return run


for _name in ("remove", "pop", "clear", "update", "difference_update", "intersection_update", "symmetric_difference_update", "__iand__", "__ixor__"):
    setattr(Edges, _name, _unknown_ends(_name))


@dataclass
class Function:
    blocks: dict[int, list[tuple]] = field(default_factory=dict)
    edges: set[tuple] = field(default_factory=set)
    info: dict = field(default_factory=dict)

    _variables = None

    def __setattr__(self, name, value):
        super().__setattr__(name, Edges(value) if name == "edges" and value.__class__ is not Edges else value)

    def variables(self, e: Tree) -> set[str]:
        """The variables of one of the function's trees, found once for each tree; not to be changed. By its id, as long as the tree is kept."""
        kept = self._variables
        if kept is None:
            kept = self._variables = {}
        at = kept.get(id(e))
        if at is None:
            at = kept[id(e)] = e, variables(e)
        return at[1]

    def out(self, v: int) -> list[tuple]:
        found = self.edges.at(0, v)
        return list(found) if len(found) < 2 else sorted(found, key=lambda e: (e[2] is not None, bool(e[2]), e[1]))

    def into(self, v: int) -> list[tuple]:
        found = self.edges.at(1, v)
        return list(found) if len(found) < 2 else sorted(found, key=lambda e: (e[0], e[2] is not None, bool(e[2])))

    def successors(self) -> dict:
        return {v: [(0, d) for _, d, _ in self.out(v)] for v in self.blocks}

    def statements(self):
        for v in sorted(self.blocks):
            for i, s in enumerate(self.blocks[v]):
                yield v, i, s


def from_statements(raw: list[tuple]) -> Function:
    """The graph of a list of statements. A label starts a block, a jump or a halt ends one; ("jmp", target), ("cjmp", tree, target, target). An unknown target is the error block, None the indirect one."""
    f = Function({ENTRY: [], EXIT: []})
    number, now, wanted, labels = 0, [], [], {}

    def close(last):
        nonlocal number, now
        if now or last:
            f.blocks[number] = now
            here, now = number, []
            number += 1
            return here
        return None

    previous = ENTRY
    for s in raw:
        if s[0] == "label" and any(x[0] != "label" for x in now):
            here = close(False)
            if previous is not None:
                f.edges.add((previous, here, None))
            previous = here
        if s[0] == "label":
            labels[s[1]] = number
        now.append(s[:1] if s[0] == "jmp" else s[:2] if s[0] == "cjmp" else s)
        if s[0] in ("jmp", "cjmp", "halt"):
            here = close(True)
            if previous is not None:
                f.edges.add((previous, here, None))
            previous = None
            if s[0] == "jmp":
                wanted.append((here, s[1], None))
            elif s[0] == "cjmp":
                wanted += [(here, s[2], True), (here, s[3], False)]
            else:
                f.edges.add((here, EXIT, None))
    here = close(False)
    if here is not None:
        if previous is not None:
            f.edges.add((previous, here, None))
        previous = here
    if previous is not None:
        f.edges.add((previous, EXIT, None))
    for src, target, label in wanted:
        dst = INDIRECT if target is None else labels.get(target, ERROR)
        if dst in SPECIAL:
            f.blocks.setdefault(dst, [])
        f.edges.add((src, dst, label))
    return f


def verify_no_calls(f: Function) -> None:
    if any(s[0] == "call" for *_, s in f.statements()):
        raise Confusing("calls")


def collect_calls(f: Function) -> None:
    if INDIRECT in f.blocks and f.into(INDIRECT):
        raise Confusing("indirect jump")
    f.info["calls"] = [s[1] for *_, s in f.statements() if s[0] == "call"]
    f.info["halts"] = sum(s[0] == "halt" for *_, s in f.statements())


def replace_calls(f: Function) -> None:
    """A call leaves the stack pointer four higher, for the return address it took."""
    sp = ("var", "esp", 32)
    for b in f.blocks.values():
        b[:] = [x for s in b for x in ((s, ("move", "esp", ("bin", "+", sp, ("int", 4, 32)))) if s[0] == "call" else (s,))]


def remove_halts(f: Function) -> None:
    f.info["halting"] = {v for v, b in f.blocks.items() if b and b[-1][0] == "halt"}
    for b in f.blocks.values():
        b[:] = [s for s in b if s[0] != "halt"]


def remove_indirect(f: Function) -> None:
    for v in (INDIRECT, ERROR):
        if v in f.blocks:
            if f.into(v):
                raise Confusing("edge to the error block" if v == ERROR else "indirect jump")
            drop(f, v)


def drop(f: Function, v: int) -> None:
    del f.blocks[v]
    f.edges -= {**f.edges.at(0, v), **f.edges.at(1, v)}


def prune(f: Function) -> None:
    seen, todo = set(), [ENTRY]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [d for _, d, _ in f.out(v)]
    for v in set(f.blocks) - seen - {EXIT}:
        drop(f, v)


def coalesce(f: Function, keep_calls: bool = False) -> None:
    """Blocks in a straight line become one, special ones stay. With keep_calls a block that ends in a call stays apart from the next."""
    # What a block takes in leaves the ways of all others as many as before, so that none before it can take in more.
    for v in sorted(set(f.blocks) - SPECIAL):
        body = None
        while v in f.blocks:
            now = f.blocks[v] if body is None else body
            out = f.edges.at(0, v)
            if len(out) != 1:
                break
            d = next(iter(out))[1]
            if d == v or d in SPECIAL or len(f.edges.at(1, d)) != 1 or keep_calls and now and now[-1][0] == "call":
                break
            body = list(now) if body is None else body
            if body and body[-1][0] == "jmp":
                body.pop()
            body += f.blocks[d]
            moved = {(v, x, label) for _, x, label in f.edges.at(0, d)}
            drop(f, d)
            f.edges |= moved
        if body is not None:
            f.blocks[v] = body


def break_after_calls(f: Function) -> None:
    """A block ends with each call; edges in lead to its first piece, edges out from its last."""
    for v in sorted(set(f.blocks) - SPECIAL):
        pieces, now = [], []
        for s in f.blocks[v]:
            now.append(s)
            if s[0] == "call":
                pieces.append(now)
                now = []
        if now:
            pieces.append(now)
        if len(pieces) < 2:
            continue
        out = f.out(v)
        f.edges -= set(out)
        at = v
        f.blocks[v] = pieces[0]
        for p in pieces[1:]:
            new = max(f.blocks) + 1
            f.blocks[new] = p
            f.edges.add((at, new, None))
            at = new
        f.edges |= {(at, d, label) for _, d, label in out}


def force_single_exit(f: Function) -> None:
    """The longest common end of all blocks before the exit moves to one new block before it."""
    ends = [s for s, _, _ in f.into(EXIT)]
    if len(ends) < 2 or ENTRY in ends:
        return
    n = 0
    while all(len(f.blocks[v]) > n for v in ends) and len({json.dumps(f.blocks[v][-1 - n]) for v in ends}) == 1:
        n += 1
    new = max(f.blocks) + 1
    f.blocks[new] = f.blocks[ends[0]][len(f.blocks[ends[0]]) - n :]
    for v in ends:
        f.blocks[v] = f.blocks[v][: len(f.blocks[v]) - n]
    f.edges = {(s, new if d == EXIT else d, label) for s, d, label in f.edges} | {(new, EXIT, None)}


def remove_noreturn_edges(f: Function, noreturn: frozenset = frozenset({"abort", "exit", "_exit"})) -> None:
    for v, b in f.blocks.items():
        if b and b[-1][0] == "call" and b[-1][1] in noreturn:
            f.edges -= {e for e in f.edges if e[0] == v and e[2] is None}
    prune(f)


def normalize_branches(f: Function) -> None:
    """Negations come off conditions, and an unequal becomes an equal; an odd number of them swaps the edges."""
    for v, b in f.blocks.items():
        if not b or b[-1][0] != "cjmp":
            continue
        e, swap = b[-1][1], False
        while True:
            match e:
                case ("un", "~", x):
                    e, swap = x, not swap
                case ("bin", "!=", x, y):
                    e, swap = ("bin", "==", x, y), not swap
                case _:
                    break
        b[-1] = ("cjmp", e)
        if swap:
            f.edges = {(s, d, not label if s == v and label is not None else label) for s, d, label in f.edges}


def drop_nops(f: Function) -> None:
    """Blocks without code leave their way to their only successor."""
    for v in sorted(set(f.blocks) - SPECIAL):
        out = f.out(v)
        if len(out) == 1 and out[0][1] != v and not any(s[0] in CODE and s[0] != "jmp" for s in f.blocks[v]):
            d = out[0][1]
            moved = {(s, d, label) for s, _, label in f.into(v)}
            drop(f, v)
            f.edges |= moved


def to_ssa(f: Function, only: set[str] | None = None) -> None:
    """Each definition gets a version; phis stand where versions meet, by dominance frontiers. With only, those of the variables named, others being in this form already."""
    succ = f.successors()
    idom = immediate_dominators(succ, ENTRY)
    frontier = defaultdict(set)
    for v in idom:
        preds = [s for s, _, _ in f.into(v) if s in idom]
        if len(preds) > 1:
            for p in preds:
                while p != idom[v]:
                    frontier[p].add(v)
                    p = idom[p]
    # Trees that name a variable which can get a version, by their ids: all stay in the blocks until they are renamed.
    defs, widths, renamed = defaultdict(set), {}, set()
    for v, _, s in f.statements():
        if s[0] == "move" and (only is None or s[1] in only):
            defs[s[1]].add(v)
        for e in s[1:]:
            if e.__class__ is tuple and e[0] not in ("int", "unknown") and (only is None or not only.isdisjoint(f.variables(e))):
                renamed.add(id(e))
                widths.update([(x[1], x[2]) for x in walk_vars(e)])
    phis = defaultdict(dict)
    for name in sorted(defs):
        todo, has = list(defs[name]), set()
        while todo:
            for d in frontier[todo.pop()]:
                if d not in has:
                    has.add(d)
                    phis[d][name] = {}
                    todo.append(d)
    below = defaultdict(list)
    for v, d in idom.items():
        if v != d:
            below[d].append(v)
    count, stacks, new = defaultdict(int), defaultdict(list), {}

    def fresh(name):
        count[name] += 1
        return f"{name}.{count[name]}"

    def now(x: Tree) -> Tree:
        versions = stacks.get(x[1])
        return ("var", versions[-1], x[2]) if versions else x

    todo = [(ENTRY, False)]
    pushed: dict[int, list[str]] = {}
    names: dict[int, dict[str, str]] = {}
    while todo:
        v, left = todo.pop()
        if left:
            for name in pushed[v]:
                stacks[name].pop()
            continue
        pushed[v], names[v], out = [], {}, []
        for name in sorted(phis[v]):
            names[v][name] = fresh(name)
            stacks[name].append(names[v][name])
            pushed[v].append(name)
        for s in f.blocks[v]:
            if id(s[-1]) in renamed:
                s = tuple([with_variables(x, now) if x.__class__ is tuple else x for x in s])
            if s[0] == "move" and (only is None or s[1] in only):
                n = fresh(s[1])
                stacks[s[1]].append(n)
                pushed[v].append(s[1])
                s = ("move", n, s[2])
            out.append(s)
        new[v] = out
        for _, d, _ in f.out(v):
            for name, args in phis[d].items():
                args[v] = stacks[name][-1] if stacks[name] else name
        todo.append((v, True))
        todo += [(x, False) for x in sorted(below[v], reverse=True)]
    for v, b in new.items():
        head = [("move", names[v][n], ("phi", *(("var", x, widths.get(n, 32)) for x in sorted(set(args.values()))))) for n, args in sorted(phis[v].items()) if n in names[v]]
        f.blocks[v] = head + b


def walk_vars(e: Tree):
    """All variables of a tree, in the order of walk."""
    found, todo = [], [e]
    while todo:
        x = todo.pop()
        if x[0] == "var":
            found.append(x)
        elif x[0] != "int":
            todo += [v for v in x[:0:-1] if v.__class__ is tuple]
    return found


def simplify(f: Function) -> None:
    """Copies and constants go to where they are used, phis of one variable are copies, and trees take their normal form, until nothing changes. A tree in normal form without variables to replace stays."""
    places = [(b, i) for b in f.blocks.values() for i, s in enumerate(b) if s[0] in ("move", "cjmp")]
    moves = [(f.blocks[v], i) for v, i, s in f.statements() if s[0] == "move"]
    # Trees in normal form by their ids, as long as they are kept; those of the last call are still in it.
    settled = f.__dict__.setdefault("_settled", {})
    users, values, todo = defaultdict(set), {}, range(len(places))
    while True:
        before, values = values, {}
        for b, i in moves:
            _, name, e = b[i]
            if e[0] in ("var", "int"):
                values[name] = e
            elif e[0] == "phi" and len(others := {x for x in e[1:] if x[1] != name}) == 1:
                values[name] = next(iter(others))
        # After the first time, a statement can change only if it did so the last time or a variable in it has another value.
        if todo.__class__ is list:
            todo = sorted({*todo, *(p for x, e in values.items() if x in users and before.get(x) != e for p in users[x])})
        changed = []
        for p in todo:
            b, i = places[p]
            s = b[i]
            tree = e = s[-1]
            if s[0] == "move" and tree[0] == "phi":
                args = [values.get(x[1], x) for x in tree[1:]]
                e = ("phi", *args) if all(a[0] == "var" for a in args) else tree
                names = {x[1] for x in e[1:]}
            else:
                names = f.variables(tree)
                same = values.keys().isdisjoint(names)
                if not same or id(tree) not in settled:
                    e = normal(tree if same else substitute(tree, values))
                    if e == tree:
                        e = tree
                    else:
                        names = f.variables(e)
                    settled[id(e)] = e
            for x in names:
                users[x].add(p)
            if e != tree:
                b[i] = (*s[:-1], e)
                changed.append(p)
        if not changed:
            return
        todo = changed


def definitions(f: Function) -> None:
    f.info["defs"] = {s[1]: (v, i) for v, i, s in f.statements() if s[0] == "move"}
    f.info["inputs"] = sorted(set().union(*[f.variables(e) for *_, s in f.statements() for e in s[1:] if e.__class__ is tuple]) - set(f.info["defs"]))


def mark_liveout(f: Function, register: str = "eax") -> None:
    """The last definitions of the return register on the way back from the exit, and stores, are live."""
    live, seen, todo = set(), set(), [EXIT]
    while todo:
        v = todo.pop()
        if v in seen:
            continue
        seen.add(v)
        own = [s[1] for s in f.blocks[v] if s[0] == "move" and s[1].split(".")[0] == register]
        if own:
            live.add(own[-1])
        else:
            todo += [s for s, _, _ in f.into(v)]
    # Arrays of the stack frame are gone with it.
    live |= {s[1] for *_, s in f.statements() if s[0] == "move" and s[2][0] == "store" and not s[1].startswith("esp[")}
    f.info["liveout"] = sorted(live)


def eliminate_dead(f: Function) -> None:
    """Moves that neither a live variable nor a branch needs go."""
    needs = {s[1]: f.variables(s[2]) for *_, s in f.statements() if s[0] == "move"}
    live, todo = set(), [*f.info.get("liveout", ()), *(x for *_, s in f.statements() if s[0] == "cjmp" for x in f.variables(s[1]))]
    while todo:
        x = todo.pop()
        if x not in live:
            live.add(x)
            todo += needs.get(x, ())
    for b in f.blocks.values():
        b[:] = [s for s in b if s[0] != "move" or s[1] in live]


def hoist(f: Function) -> None:
    """Buoyancy: a definition that is no load, store, phi nor live at the end rises to just after the operand that the others dominate, constants to the entry; never within its block."""
    definitions(f)
    idom = immediate_dominators(f.successors(), ENTRY)
    depth = {ENTRY: 0}
    for v in idom:
        path = [v]
        while path[-1] not in depth:
            path.append(idom[path[-1]])
        for x, above in zip(path[-2::-1], path[::-1]):
            depth[x] = depth[above] + 1
    for v in sorted(idom, key=lambda x: (depth[x], x)):
        for s in list(f.blocks[v]):
            if s[0] != "move" or s[2][0] == "phi" or s[1] in f.info.get("liveout", ()) or memory_nodes(s[2]):
                continue
            names = f.variables(s[2])
            where = [f.info["defs"][x][0] for x in names if x in f.info["defs"]]
            to = max(where, key=lambda x: depth.get(x, -1), default=ENTRY)
            if to == v or to not in depth:
                continue
            f.blocks[v].remove(s)
            at = max((i for i, x in enumerate(f.blocks[to]) if x[0] == "move" and x[1] in names), default=-1) + 1
            f.blocks[to].insert(at, s)
            f.info["defs"][s[1]] = (to, at)


def pipeline() -> list[tuple]:
    """The default order. Analyses read the function and leave what they find in its info."""
    from . import memory_passes as M

    return [
        ("CollectCalls", collect_calls), ("ReplaceCalls", replace_calls), ("RemoveHalts", remove_halts), ("RemoveIndirect", remove_indirect), ("Prune1", prune), ("Coalesce1", lambda f: coalesce(f, True)),
        ("BreakAfterCalls1", break_after_calls), ("TrimDefinitions", M.trim_definitions), ("SummarizeCalls", M.summarize_calls), ("Prune2", prune), ("Coalesce2", lambda f: coalesce(f, True)), ("BreakAfterCalls2", break_after_calls),
        ("ForceSingleExit", force_single_exit), ("AddressMap", M.address_map), ("StartSsa", to_ssa), ("NormalizeBranches", normalize_branches), ("Simplify1", simplify), ("DropNops1", drop_nops), ("Definitions1", definitions),
        ("NameArrays", M.name_arrays), ("Simplify2", simplify), ("Definitions2", definitions), ("FindCollapsible", M.find_collapsible), ("RemoveNoreturnEdges", remove_noreturn_edges), ("MarkLiveout", mark_liveout),
        ("DeadCode1", eliminate_dead), ("CoalesceSsa1", coalesce), ("Buoyancy", hoist), ("Simplify3", simplify), ("DeadCode2", eliminate_dead), ("CoalesceSsa2", coalesce), ("DropNops2", drop_nops),
    ]


def registered() -> dict:
    """All passes by name, those outside the default order included."""
    from . import memory_passes as M

    extra = {"VerifyNoCalls": verify_no_calls, "RemoveSpecial": M.remove_special, "Coerce": M.coerce, "Coalesce3": coalesce, "PropagatePhis": M.propagate_phis, "CollapseLoads": M.collapse_loads, "SinkPartial": M.sink_partial}
    return dict(pipeline()) | extra


def run_passes(f: Function, passes=None) -> tuple[Function, str | None]:
    """The function after all passes, or as far as they came and why not further: no function ends the job."""
    for name, p in pipeline() if passes is None else passes:
        try:
            p(f)
        except Confusing as e:
            return f, f"{name}: {e}"
        except Exception as e:  # noqa: BLE001  whatever is wrong with one function is its own matter
            return f, f"{name}: {type(e).__name__}: {e}"
    return f, None


SCHEMA = "func long, block int, pos int, kind string, avar string, tree string, reason string"


def normalized(stmts: DataFrame, passes=None) -> DataFrame:
    """func, block, pos, kind, avar, tree of each function's statements after the passes; one row with the reason of a function that is confusing.

    stmts: func, pos, kind, avar (the variable, label or call), tree, target, other (jump targets). A function's statements are one group.
    """

    import pyarrow as pa

    from .tables import by_key

    decoded = Decoded()

    def run(func, rows: list[tuple]) -> list[tuple]:
        raw = []
        for _, _, kind, avar, tree, target, other in rows:
            e = None if tree is None else decoded[tree]
            raw.append({"move": ("move", avar, e), "jmp": ("jmp", target), "cjmp": ("cjmp", e, target, other), "halt": ("halt",)}.get(kind, (kind, avar)))
        f, why = run_passes(from_statements(raw), passes)
        if why:
            return [(func, None, None, None, None, None, why)]
        return [(func, v, i, s[0], s[1] if s[0] in ("move", "label", "call", "comment") else None, encode(s[-1]) if s[0] in ("move", "cjmp") else None, None) for v, i, s in f.statements()]

    rows = stmts.select("func", "pos", "kind", "avar", "tree", "target", "other")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
    return by_key(rows, ["pos"], run, SCHEMA, dict(zip((c.split()[0] for c in SCHEMA.split(", ")), kinds)))
