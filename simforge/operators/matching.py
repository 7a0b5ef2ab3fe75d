"""Correspondences of variables, and matching of functions under them.

A correspondence is a list of (left names, right names), two sets of one size:
each left name stands for one of the right ones. Matching is greedy and its
order is defined: outputs by name, blocks by number. correspondences has the same
refinement for whole tables.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .expressions import COMMUTATIVE, Tree, children, decode, evaluate, folded, walk, width

Pairing = tuple[frozenset, frozenset]


class Conflict(Exception):
    """Two correspondences that can't both hold."""


def canonical(pairings) -> list[Pairing]:
    return sorted(set(pairings), key=lambda p: (sorted(p[0]), sorted(p[1])))


def split(a: Pairing, b: Pairing) -> list[Pairing] | None:
    """The parts of both, none if they share nothing; Conflict if they share a different number on each side."""
    left, right = a[0] & b[0], a[1] & b[1]
    if len(left) != len(right):
        raise Conflict(f"{sorted(left)} against {sorted(right)}")
    if not left:
        return None
    return [p for p in ((a[0] - left, a[1] - right), (b[0] - left, b[1] - right), (left, right)) if p[0]]


def merge(first, second) -> list[Pairing]:
    """Both at once, in the finest parts that follow. Names are held against each other on either side."""
    done: list[Pairing] = []
    todo = [*first, *second]
    while todo:
        new = todo.pop()
        if len(new[0]) != len(new[1]):
            raise Conflict("sides of different size")
        for i, old in enumerate(done):
            if new == old:
                break
            parts = split(old, new)
            if parts:
                del done[i]
                todo.extend(parts)
                break
        else:
            done.append(new)
    return canonical(done)


def simplify(first, second) -> tuple[list[Pairing], list[Pairing]]:
    """Each list in the parts that the other cuts it into, the two kept apart."""

    def cut(these, by):
        out = list(these)
        for b in by:
            parts = []
            for a in out:
                left, right = a[0] & b[0], a[1] & b[1]
                if len(left) != len(right):
                    raise Conflict(f"{sorted(left)} against {sorted(right)}")
                parts += [p for p in ((a[0] - left, a[1] - right), (left, right)) if p[0]]
            out = parts
        return canonical(out)

    return cut(first, second), cut(second, first)


def holds(pairings, left: str, right: str) -> bool:
    """Whether the pair agrees with a correspondence."""
    try:
        merge(pairings, [(frozenset([left]), frozenset([right]))])
    except Conflict:
        return False
    return True


def as_formula(pairings) -> str:
    """For each pairing, an OR over assignments of the ANDs of their equalities."""
    from itertools import permutations

    each = lambda p: " | ".join("(" + " & ".join(f"{a}={b}" for a, b in zip(sorted(p[0]), r)) + ")" for r in permutations(sorted(p[1])))
    return " & ".join(f"({each(p)})" for p in canonical(pairings))


# Terms


#: An array of the frame that begins at the return address or above: an argument of the function.
ARGUMENT = re.compile(r"esp(?:\.\d+)?\[(\d+):(\d+)\](?:\.\d+)?")


def names_of(e: Tree) -> list[str] | None:
    """The names that a term stands for, if it does nothing but stand for them: a variable, a phi, a load from a phi of arrays, or a load of a whole argument from the stack. None for other terms."""
    match e:
        case ("var", name, _):
            return [name]
        case ("phi", *vs) | ("load", ("phi", *vs), _, _):
            return [v[1] for v in vs]
        case ("load", ("var", name, _), _, w) if (m := ARGUMENT.fullmatch(name)) and 8 * (int(m[2]) - int(m[1]) + 1) == w:
            return [name]
    return None


def constant_of(e: Tree) -> tuple[int, int] | None:
    """(value, width) of a number, or of a store of one."""
    match e:
        case ("int", v, w) | ("store", _, _, ("int", v, w), _):
            return v, w
    return None


def bag_of(e: Tree) -> tuple[list[str], list[Tree]]:
    """The names and the other operands of a commutative operation, those of the same operation below it included."""
    names, others, todo = [], [], [e]
    while todo:
        for x in todo.pop()[2:]:
            if x[0] == "bin" and x[1] == e[1]:
                todo.append(x)
            elif (found := names_of(x)) is not None:
                names += found
            else:
                others.append(x)
    return names, others


def by_count(left: list[str], right: list[str]) -> list[Pairing] | None:
    """Names that stand equally often on both sides, as pairings; none if the numbers differ."""
    sides = []
    for names in (left, right):
        often = defaultdict(set)
        for name, n in Counter(names).items():
            often[n].add(name)
        sides.append(often)
    if {n: len(v) for n, v in sides[0].items()} != {n: len(v) for n, v in sides[1].items()}:
        return None
    return [(frozenset(sides[0][n]), frozenset(sides[1][n])) for n in sorted(sides[0])]


def _digest(x) -> str:
    return hashlib.blake2b(repr(x).encode(), digest_size=12).hexdigest()


def fingerprint(e: Tree) -> str:
    """What a tree is without its names and the order of commutative operands. Trees that can be equivalent have the same."""

    def done(x) -> str:
        return _digest(x) if isinstance(x, tuple) else x

    def node(x: Tree, kids: list):
        names = names_of(x)
        if names is not None:
            return "names", tuple(sorted(Counter(names).values()))
        number = constant_of(x)
        if number is not None:
            return ("number", *number)
        if x[0] == "bin" and x[1] in COMMUTATIVE:
            # A bag is left open, as the same operation above takes it over.
            names, parts = [], []
            for child, k in zip(x[2:], kids):
                if k[0] == "bag" and k[1] == x[1]:
                    names += k[2]
                    parts += k[3]
                elif (found := names_of(child)) is not None:
                    names += found
                else:
                    parts.append(closed(k))
            return "bag", x[1], names, parts
        fields = tuple(v for i, v in enumerate(x) if not (i and isinstance(v, tuple)))
        return ("node", fields, tuple(closed(k) for k in kids))

    def closed(k: tuple) -> str:
        return done(("bag", k[1], tuple(sorted(Counter(k[2]).values())), tuple(sorted(k[3])))) if k[0] == "bag" else done(k)

    return closed(folded(e, node))


def equivalent(a: Tree, b: Tree, known: list[Pairing] = (), marks: dict | None = None) -> list[Pairing] | None:
    """A correspondence, finer than the known one, under which the trees are equal; none if there is none.

    Terms that stand for names correspond whatever their kind, a variable or a phi,
    a load from a phi, or an argument's load against a register; numbers equal
    stores of them. The names in a commutative operation correspond as a set, and so
    do those of the same operation nested in it; its other operands are tried in
    every order that their fingerprints allow. So the order of such operands doesn't
    matter. Unknown trees equal nothing.
    """
    marks = {} if marks is None else marks

    def mark(x: Tree) -> str:
        # The tree is kept, so that its id stays its own.
        if id(x) not in marks:
            marks[id(x)] = fingerprint(x), x
        return marks[id(x)][0]

    # What is left to compare is a chain of pairs of trees, or of lists of operands in some order.
    others = [((a, b, None), list(known))]
    while others:
        todo, now = others.pop()
        while todo is not None:
            x, y, todo = todo
            if isinstance(x, list):
                if not x:
                    continue
                fits = [i for i, z in enumerate(y) if mark(z) == mark(x[0])]
                if not fits:
                    break
                nexts = [(x[0], y[i], (x[1:], y[:i] + y[i + 1 :], todo)) for i in fits]
                others += [(n, now) for n in reversed(nexts[1:])]
                todo = nexts[0]
                continue
            pairs = None
            names, numbers = (names_of(x), names_of(y)), (constant_of(x), constant_of(y))
            if names[0] is not None and names[1] is not None:
                same = x[0] != "var" or y[0] != "var" or x[2] == y[2]
                pairs = [tuple(map(frozenset, names))] if same and len(names[0]) == len(names[1]) else None
            elif numbers[0] is not None and numbers[1] is not None:
                pairs = [] if numbers[0] == numbers[1] else None
            elif x[0] == y[0] != "unknown" and children(x) == children(y) and all(v == w for i, (v, w) in enumerate(zip(x, y)) if i not in children(x)):
                if x[0] == "bin" and x[1] in COMMUTATIVE:
                    left, right = bag_of(x), bag_of(y)
                    if len(left[1]) == len(right[1]):
                        pairs = by_count(left[0], right[0])
                        todo = (left[1], right[1], todo)
                else:
                    pairs = []
                    for i in reversed(children(x)):
                        todo = (x[i], y[i], todo)
            if pairs is None:
                break
            try:
                now = merge(now, pairs) if pairs else now
            except Conflict:
                break
        else:
            return now
    return None


def constant_value(e: Tree) -> tuple[int, int] | None:
    """(value, width) of a tree without inputs; none if it has some, or no value."""
    if any(x[0] in ("var", "load", "phi", "unknown") for x in walk(e)):
        return None

    def node(x: Tree, kids: list) -> Tree:
        new = iter(kids)
        x = tuple(next(new) if i in children(x) else v for i, v in enumerate(x))
        return x if x[0] == "int" else ("int", evaluate(x, {}), width(x))

    try:
        return folded(e, node)[1:]
    except (ZeroDivisionError, KeyError, ValueError, TypeError):
        return None


def pair_constants(left: dict[str, Tree], right: dict[str, Tree]) -> tuple[list[Pairing], int, set[str], set[str]]:
    """(pairings, how many match, names left over by them on the left, on the right) of the outputs without inputs.

    Outputs of one value are one bucket. As many match as the smaller side has; if
    both have as many, the bucket is one pairing, and otherwise nothing is said about
    which stands for which. No order of outputs changes that.
    """
    buckets: dict = defaultdict(lambda: ([], []))
    for side, outputs in enumerate((left, right)):
        for name in sorted(outputs):
            value = constant_value(outputs[name])
            if value is not None:
                buckets[value][side].append(name)
    pairings = [(frozenset(a), frozenset(b)) for a, b in buckets.values() if a and len(a) == len(b)]
    return pairings, sum(min(len(a), len(b)) for a, b in buckets.values()), {x for a, _ in buckets.values() for x in a}, {x for _, b in buckets.values() for x in b}


@dataclass(frozen=True)
class BlockMatch:
    """How two blocks compare: kind, outputs that match, outputs in all, and the pairings of inputs and of outputs under which they do."""

    kind: str
    matched: int
    total: int
    ins: tuple[Pairing, ...] = ()
    outs: tuple[Pairing, ...] = ()
    compared: int = 0


def pair_outputs(left: dict[str, Tree], right: dict[str, Tree], known: list[Pairing] = (), marks: dict | None = None) -> tuple[list[tuple[str, str]], list[Pairing], int]:
    """Pairs of outputs with equivalent trees, in order of names, what they imply of inputs, and how many trees were compared: outputs meet those of their fingerprint alone."""
    marks = {} if marks is None else marks
    index, pairs, n, known = defaultdict(list), [], 0, list(known)

    def mark(x: Tree) -> str:
        if id(x) not in marks:
            marks[id(x)] = fingerprint(x), x
        return marks[id(x)][0]

    for y in sorted(right):
        index[mark(right[y])].append(y)
    for x in sorted(left):
        free = index.get(mark(left[x]), [])
        for y in free:
            n += 1
            got = equivalent(left[x], right[y], known, marks)
            if got is not None:
                pairs.append((x, y))
                free.remove(y)
                known = got
                break
    return pairs, known, n


def block_kind(direct: int, left: int, right: int) -> str:
    if not left and not right:
        return "Exact"
    if not right:
        return "Superset"
    if not left:
        return "Subset"
    return "Partial" if direct else "Fail"


def compare_blocks(left: dict[str, Tree] | None, right: dict[str, Tree] | None, marks: dict | None = None) -> BlockMatch:
    """A block without transfer functions (None) fails."""
    if left is None or right is None:
        return BlockMatch("Fail", 0, 0)
    buckets, n, ours, theirs = pair_constants(left, right)
    pairs, ins, compared = pair_outputs({x: e for x, e in left.items() if x not in ours}, {y: e for y, e in right.items() if y not in theirs}, [], marks)
    n += len(pairs)
    a, b = len(left) - n, len(right) - n
    outs = [*buckets, *((frozenset([x]), frozenset([y])) for x, y in pairs)]
    return BlockMatch(block_kind(n, a, b), n, n + a + b, tuple(ins), tuple(canonical(outs)), compared)


POLICIES = {
    # (whether a block may be a seed, kinds that a seed may have)
    "exhaustive": (lambda l, r: True, {"Exact"}),
    "whole-function": (lambda l, r: l and r, {"Exact"}),
    "fuzzy-inline": (lambda l, r: l, {"Exact", "Subset", "Superset", "Partial"}),
}


class Parts:
    """The finest parts of pairings that hold at once, refined by one pairing at a time, with a journal by which refinements are taken back."""

    def __init__(self):
        self.have: set = set()
        self.part_of: tuple[dict, dict] = ({}, {})
        self.names: list[tuple[set, set]] = []

    def add(self, pairing: Pairing, journal: list) -> bool:
        """False if it is in conflict, which changes nothing."""
        groups: dict = defaultdict(lambda: ([], []))
        for side in (0, 1):
            for name in pairing[side]:
                groups[self.part_of[side].get(name)][side].append(name)
        if any(len(a) != len(b) for a, b in groups.values()):
            return False
        for part, moved in groups.items():
            if part is None or len(moved[0]) < len(self.names[part][0]):
                self._move(part, len(self.names), moved)
                journal.append((self._back, part, len(self.names) - 1, moved))
        self.have.add(pairing)
        journal.append((self.have.discard, pairing))
        return True

    def _move(self, old: int | None, new: int, moved: tuple[list, list]) -> None:
        self.names.append((set(moved[0]), set(moved[1])))
        for side in (0, 1):
            if old is not None:
                self.names[old][side].difference_update(moved[side])
            self.part_of[side].update(dict.fromkeys(moved[side], new))

    def _back(self, old: int | None, new: int, moved: tuple[list, list]) -> None:
        self.names.pop()
        for side in (0, 1):
            if old is None:
                for name in moved[side]:
                    del self.part_of[side][name]
            else:
                self.names[old][side].update(moved[side])
                self.part_of[side].update(dict.fromkeys(moved[side], old))

    def fits(self, other: Parts) -> bool:
        """Whether both could hold: as many names on either side are in a part of one and a part of the other."""
        count: Counter = Counter()
        for side, sign in ((0, 1), (1, -1)):
            for name, part in self.part_of[side].items():
                if name in other.part_of[side]:
                    count[part, other.part_of[side][name]] += sign
        return not any(count.values())

    def pairings(self) -> list[Pairing]:
        return canonical((frozenset(a), frozenset(b)) for a, b in self.names if a)


class Fragment:
    """Blocks of two functions that are matched, the edges between them, and the pairings that have reached each.

    As long as all pairings of all matched blocks hold at once, none can conflict
    anywhere, whatever way they go, so that they are not sent on until flowed asks
    for it. A pair of blocks that breaks this is tried with those pairings alone
    that share names with its own; if it is taken, pairings are sent on from then on.
    """

    def __init__(self, left: dict, right: dict, links: list | None = None):
        self.sides = left, right
        self.links = [] if links is None else links
        for side in self.sides if links is None else ():
            into, out = defaultdict(list), defaultdict(list)
            for s, d, label in sorted(side["edges"], key=lambda e: (e[0], e[1], str(e[2]))):
                out[s].append((label, d))
                into[d].append((label, s))
            self.links.append((into, out))
        self.start()

    def start(self) -> None:
        """Nothing is matched."""
        self.at: dict = {}
        self.back: dict = {}
        self.edges: list = []
        #: What has reached a left block: pairings of inputs from its successors, and of outputs from its predecessors.
        self.flows: tuple[dict, dict] = ({}, {})
        #: Matched predecessors and successors.
        self.ways: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
        #: All pairings at once; none once they don't hold at once, and flows are kept.
        self.whole: Parts | None = Parts()

    def state(self) -> tuple:
        return self.at, self.back, self.edges, self.flows, self.ways, self.whole

    def restore(self, state: tuple) -> None:
        self.at, self.back, self.edges, self.flows, self.ways, self.whole = state

    def flowed(self) -> tuple[dict, dict]:
        """The pairings that have reached each block."""
        if self.whole is None:
            return self.flows
        return self.sent(None).flows

    def sent(self, only: set | None) -> Fragment:
        """The same blocks and edges with their pairings, or only some of them, sent on."""
        f = Fragment(*self.sides, self.links)
        f.whole, f.at, f.back, f.edges = None, dict(self.at), dict(self.back), list(self.edges)
        for mine, its in zip(self.ways, f.ways):
            its.update((v, list(w)) for v, w in mine.items())
        for x, (_, m) in self.at.items():
            for flow, own in zip(f.flows, (m.ins, m.outs)):
                flow[x] = Parts()
                for p in own:
                    if only is None or p in only:
                        flow[x].add(p, [])
        f.settle(set(f.at), [])
        return f

    def sharing(self, m: BlockMatch) -> set:
        """The pairings of a match, and all that share names with them, or with those that do."""
        have = {p for _, other in self.at.values() for p in (*other.ins, *other.outs)}
        named = defaultdict(list)
        for p in have:
            for side in (0, 1):
                for name in p[side]:
                    named[side, name].append(p)
        todo, found = [*m.ins, *m.outs], set()
        while todo:
            p = todo.pop()
            if p not in found:
                found.add(p)
                for side in (0, 1):
                    for name in p[side]:
                        todo += named.pop((side, name), ())
        return found

    def of_use(self, pairing: Pairing, x) -> bool:
        """Whether a pairing goes to a block: some name of it, on either side, is of use there."""
        for names, side, block in zip(pairing, self.sides, (x, self.at[x][0])):
            seen = side.get("seen")
            if seen is not None and names.isdisjoint(seen.get(block, ())):
                return False
        return True

    def connect(self, x) -> list[tuple]:
        """The edges between x and matched blocks: those of one label whose ends are matched to each other, along which what the source puts out agrees with what the target takes in."""
        y, found = self.at[x][0], []
        for side in (0, 1):
            taken = set()
            for label, c in self.links[0][side][x]:
                if c not in self.at or side and c == x:
                    continue
                e = self.at[c][0]
                fits = [i for i, (other, d) in enumerate(self.links[1][side][y]) if d == e and other is label and i not in taken]
                source, target = (c, x) if side == 0 else (x, c)
                if fits and (self.whole is not None or self.flows[1][source].fits(self.flows[0][target])):
                    taken.add(fits[0])
                    found.append((source, target, label))
        return found

    def settle(self, near: set, journal: list) -> bool:
        """Sends pairings on from these blocks until nothing new comes anywhere: those of outputs along matched edges, those of inputs against them. False on a conflict."""
        order = sorted(self.at)
        for side in (0, 1):
            # Blocks come in the order in which pairings go, as far as there is one, so that each sends on at once what it gets.
            flow, place = self.flows[side], {v: i if side else -i for i, v in enumerate(order)}
            todo = sorted((place[v], v) for v in near)
            waiting = set(near)
            while todo:
                _, v = heapq.heappop(todo)
                waiting.discard(v)
                for w in self.ways[side][v]:
                    new = [p for p in flow[v].have if p not in flow[w].have and self.of_use(p, w)]
                    for p in new:
                        if not flow[w].add(p, journal):
                            return False
                    if new and w not in waiting:
                        waiting.add(w)
                        heapq.heappush(todo, (place[w], w))
        return True

    def add(self, x, y, m: BlockMatch) -> bool:
        """Matches a further pair of blocks, if an edge to another matched block connects it and no pairing conflicts anywhere. Otherwise nothing changes."""
        if self.whole is not None and not self._held(m):
            only = self.sharing(m)
            own = lambda ps: tuple(p for p in ps if p in only)
            if not self.sent(only).add(x, y, BlockMatch(m.kind, m.matched, m.total, own(m.ins), own(m.outs))):
                return False
            self.restore(self.sent(None).state())
        journal: list = []
        first, whole = not self.at, self.whole
        self.at[x], self.back[y] = (y, m), x
        ok = True
        if whole is None:
            self.flows[0][x], self.flows[1][x] = Parts(), Parts()
            ok = all(flow[x].add(p, journal) for flow, own in zip(self.flows, (m.ins, m.outs)) for p in own)
        edges = self.connect(x) if ok else []
        for s, d, _ in edges:
            self.ways[0][d].append(s)
            self.ways[1][s].append(d)
        if ok and (first or any(s != d for s, d, _ in edges)):
            if whole is not None:
                for p in (*m.ins, *m.outs):
                    if p not in whole.have:
                        whole.add(p, [])
                self.edges += edges
                return True
            if self.settle({x, *[v for e in edges for v in e[:2]]}, journal):
                self.edges += edges
                return True
        for undo, *what in reversed(journal):
            undo(*what)
        for s, d, _ in edges:
            self.ways[0][d].remove(s)
            self.ways[1][s].remove(d)
        del self.at[x], self.back[y]
        for flow in self.flows:
            flow.pop(x, None)
        return False

    def _held(self, m: BlockMatch) -> bool:
        """Whether the pairings of a match hold at once with all others. Changes nothing."""
        journal: list = []
        ok = all(p in self.whole.have or self.whole.add(p, journal) for p in (*m.ins, *m.outs))
        for undo, *what in reversed(journal):
            undo(*what)
        return ok

    def grow(self, x, compare) -> None:
        """Grows along edges of equal labels from a matched block, predecessors before successors, blocks that were matched last first.

        Until the first pair that isn't exact, exact, subset and superset pairs are
        taken; after it, exact ones and those of its kind. A pair that no edge
        connects without a conflict, or that brings one about elsewhere, isn't taken.
        """
        first = None if self.at[x][1].kind == "Exact" else self.at[x][1].kind
        todo = [x]
        while todo:
            a = todo.pop()
            b, came = self.at[a][0], []
            for side in (0, 1):
                for label, c in self.links[0][side][a]:
                    for other, e in self.links[1][side][b]:
                        if label is not other or c in self.at or e in self.back:
                            continue
                        m = compare(c, e)
                        if m.kind in ({"Exact", "Subset", "Superset"} if first is None else {"Exact", first}) and self.add(c, e, m):
                            first = m.kind if first is None and m.kind != "Exact" else first
                            came.append(c)
                            break
            todo += reversed(came)


def match_functions(left: dict, right: dict, policy: str = "whole-function", entry: int = -4, pairings: bool = True) -> dict:
    """left, right: {"blocks": {id: outputs}, "edges": [(src, dst, label)]}, and seen, {block: names of use there}, if pairings go to some blocks only. Gives matched block pairs with their kinds, matched edges, the pairings at each (parts and known, empty without pairings), and the classification.

    Every seed that the policy allows grows a fragment; the first of the largest
    counts. Fragments grow by a block at a time, which ends them.
    """
    seed_ok, seed_kinds = POLICIES[policy]
    marks: dict = {}
    done: dict = {}
    memo = left.get("memo")

    def compare(x, y) -> BlockMatch:
        if (x, y) not in done:
            a, b = left["blocks"].get(x), right["blocks"].get(y)
            done[x, y] = compare_blocks(a, b, marks) if memo is None else memo.compare(a, b)
        return done[x, y]

    f = Fragment(left, right)
    best = f.state()
    for x in sorted(left["blocks"]):
        for y in sorted(right["blocks"]):
            if seed_ok(x == entry, y == entry) and (m := compare(x, y)).kind in seed_kinds:
                f.start()
                if f.add(x, y, m):
                    f.grow(x, compare)
                    if len(f.at) > len(best[0]):
                        best = f.state()
    f.restore(best)
    at, matched_edges, flows = f.at, f.edges, f.flowed() if pairings else None
    pairs = [(a, b, m.kind, m.matched, m.total) for a, (b, m) in sorted(at.items())]
    kinds = [p[2] for p in pairs]
    n, s1, s2 = len(pairs), len(left["blocks"]), len(right["blocks"])
    fuzz = "Fuzzy" if "Partial" in kinds or {"Subset", "Superset"} <= set(kinds) else "SubsetAndExact" if "Subset" in kinds else "SupersetAndExact" if "Superset" in kinds else "ExactOnly"
    overlap = "Total" if n == s1 == s2 else "Superset" if n == s2 and n else "Subset" if n == s1 and n else "Partial"
    mean = sum(1.0 if p[2] == "Exact" else p[3] / p[4] for p in pairs) / n if n else 0.0
    parts = {x: (flows[0][x].pairings(), flows[1][x].pairings()) for x in at} if pairings else {}
    known = canonical(p for ins, _ in parts.values() for p in ins)
    compared = sum(m.compared for m in done.values())
    return {"pairs": pairs, "edges": sorted(matched_edges, key=str), "parts": parts, "known": known, "fuzz": fuzz, "overlap": overlap, "n": n, "d": max(s1, s2), "mean": mean, "compared": compared}


class Memo:
    """How blocks compare, by their outputs as text: blocks that are alike are decoded and compared once for as many functions as have them. Bounded."""

    MANY = 20_000

    def __init__(self):
        self.matches: dict = {}
        self.trees: dict = {}

    def compare(self, left: dict[str, str] | None, right: dict[str, str] | None) -> BlockMatch:
        """left, right: outputs with their trees as text, in order of names."""
        key = tuple(None if side is None else tuple(side.items()) for side in (left, right))
        m = self.matches.get(key)
        if m is None:
            if len(self.matches) >= self.MANY:
                self.matches.clear()
            m = self.matches[key] = compare_blocks(*[None if side is None else {x: self._tree(t) for x, t in side.items()} for side in (left, right)])
        return m

    def _tree(self, text: str) -> Tree:
        if text not in self.trees:
            if len(self.trees) >= self.MANY:
                self.trees.clear()
            self.trees[text] = decode(text)
        return self.trees[text]


def per_pair(blocks: DataFrame, edges: DataFrame, f, schema: str, types: dict) -> DataFrame:
    """f(left, right), as match_functions takes them, for each cluster with a left and a right function. blocks: cluster, side, block, output, tree; edges: cluster, side, src, dst, label. Rows of another side, and edges with a null end, are left out."""
    from pyspark.sql import functions as F

    from .tables import by_key

    none = lambda kind: F.lit(None).cast(kind)
    rows = blocks.where("block is not null").select("cluster", "side", "block", "output", "tree", none("int").alias("src"), none("int").alias("dst"), none("boolean").alias("label"))
    rows = rows.unionByName(edges.where("src is not null and dst is not null").select("cluster", "side", none("int").alias("block"), none("string").alias("output"), none("string").alias("tree"), "src", "dst", "label"))

    memo = Memo()

    def run(cluster, rows: list[tuple]) -> list[tuple]:
        sides: dict = {s: {"blocks": {}, "edges": [], "memo": memo} for s in ("left", "right")}
        for _, side, block, output, tree, src, dst, label in rows:
            if block is None:
                sides[side]["edges"].append((src, dst, label))
                continue
            outs = sides[side]["blocks"].setdefault(block, {})
            if output is not None and tree is not None:
                outs[output] = tree
        if not all(x["blocks"] for x in sides.values()):
            return []
        return [(cluster, *r) for r in f(sides["left"], sides["right"])]

    return by_key(rows.where("side in ('left', 'right')"), ["side", "block", "output", "src", "dst"], run, f"cluster long, {schema}", {"cluster": pa.int64()} | types)


def match_pairs(blocks: DataFrame, edges: DataFrame, policy: str = "whole-function") -> DataFrame:
    """cluster, fuzz, overlap, n, d, mean for each cluster with a left and a right function, as per_pair takes them."""

    def run(left, right):
        m = match_functions(left, right, policy, pairings=False)
        return [tuple(m[c] for c in ("fuzz", "overlap", "n", "d", "mean"))]

    return per_pair(blocks, edges, run, "fuzz string, overlap string, n long, d long, mean double", {"fuzz": pa.string(), "overlap": pa.string(), "n": pa.int64(), "d": pa.int64(), "mean": pa.float64()})


def matched_blocks(blocks: DataFrame, edges: DataFrame, policy: str = "whole-function", pairings: bool = True) -> DataFrame:
    """cluster, l, r, kind, matched, total, ins, outs of every matched pair of blocks, with the pairings (as text) that reach it; null without pairings, which are as many as blocks times those before them."""
    text = lambda ps: ";".join(f"{','.join(sorted(a))}={','.join(sorted(b))}" for a, b in ps)

    def run(left, right):
        m = match_functions(left, right, policy, pairings=pairings)
        return [(*p, *(map(text, m["parts"][p[0]]) if pairings else (None, None))) for p in m["pairs"]]

    types = {"l": pa.int32(), "r": pa.int32(), "kind": pa.string(), "matched": pa.int32(), "total": pa.int32(), "ins": pa.string(), "outs": pa.string()}
    return per_pair(blocks, edges, run, "l int, r int, kind string, matched int, total int, ins string, outs string", types)


def matched_edges(blocks: DataFrame, edges: DataFrame, policy: str = "whole-function") -> DataFrame:
    """cluster, src, dst, label: the left function's edges that are matched."""
    types = {"src": pa.int32(), "dst": pa.int32(), "label": pa.bool_()}
    return per_pair(blocks, edges, lambda left, right: match_functions(left, right, policy, pairings=False)["edges"], "src int, dst int, label boolean", types)


def fingerprints(trees: DataFrame) -> DataFrame:
    """trees (any columns, tree) with fingerprint, worked out once for each different tree. Trees that don't decode, and nulls, have none."""

    def run(batches):
        for b in batches:
            found = []
            for text in b.column(0).to_pylist():
                try:
                    found.append(fingerprint(decode(text)))
                except (ValueError, TypeError, IndexError, AttributeError):
                    found.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["tree", "fingerprint"])

    each = trees.select("tree").where("tree is not null").distinct().mapInArrow(run, "tree string, fingerprint string")
    return trees.join(each, "tree", "left").select(*trees.columns, "fingerprint")


def candidate_outputs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, l_output, r_output: outputs (keys, output, tree) of both sides that can be equivalent, by a join of their fingerprints; all others can't."""
    from pyspark.sql import functions as F

    of = lambda t, s: fingerprints(t).where("fingerprint is not null").select(*keys, "fingerprint", F.col("output").alias(f"{s}_output"))
    return of(left, "l").join(of(right, "r"), [*keys, "fingerprint"]).select(*keys, "l_output", "r_output")


CLASSES = ("reg", "stack", "global", "heap")


def by_class(left: dict[str, tuple], right: dict[str, tuple]) -> list[Pairing] | None:
    """The pairings that inputs of two functions must have for their values to correspond: registers with stack slots, globals with globals, heap arrays with those of the same bounds. None where a class has more members on one side.

    left, right: variable to (class,), for a heap array to ("heap", low, high, base
    register). Heap arrays of one bounds also pair their base registers.
    """

    def classes(side: dict[str, tuple]) -> dict:
        out: dict = {}
        for v, (kind, *rest) in sorted(side.items()):
            if kind not in CLASSES:
                raise ValueError(f"no class {kind}")
            out.setdefault(("heap", *rest[:2]) if kind == "heap" else ("frame",) if kind in ("reg", "stack") else (kind,), set()).add(v)
        return out

    a, b = classes(left), classes(right)
    if a.keys() != b.keys() or any(len(a[k]) != len(b[k]) for k in a):
        return None
    out = [(frozenset(a[k]), frozenset(b[k])) for k in sorted(a, key=repr)]
    for k in a:
        if k[0] == "heap":
            bases = tuple(frozenset(side[v][3] for v in part[k] if len(side[v]) > 3) for side, part in ((left, a), (right, b)))
            if len(bases[0]) != len(bases[1]):
                return None
            if bases[0]:
                out.append(bases)
    try:
        return merge(out, [])
    except Conflict:
        return None
