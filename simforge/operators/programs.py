"""Analyses of whole functions as tables: value sets, regions of addresses, heights, pointers, kills, calls.

Statements are rows (func, pos, kind, avar, tree, target, other), as the passes
take them. A function is one Python call. One that an analysis can't settle gives
no rows there, and passes.normalized tells why. Null functions are one function.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strided as N
from . import memory_passes as M
from . import passes as P
from . import regions as R
from .expressions import Decoded, walk
from .tables import by_key, fixpoint

KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


#: Functions of one task have many trees in common.
DECODED = Decoded()


def statements_of(rows: list[tuple]) -> list[tuple]:
    out = []
    for _, _, kind, avar, tree, target, other in rows:
        e = None if tree is None else DECODED[tree]
        out.append({"move": ("move", avar, e), "jmp": ("jmp", target), "cjmp": ("cjmp", e, target, other), "halt": ("halt",)}.get(kind, (kind, avar)))
    return out


def per_function(stmts: DataFrame, f: Callable[[P.Function], list[tuple]], schema: str, passes=None) -> DataFrame:
    """func, and the rows that f gives for each function after the passes (none: as its statements stand)."""

    def run(func, rows: list[tuple]) -> list[tuple]:
        g, why = P.run_passes(P.from_statements(statements_of(rows)), passes or [])
        if why:
            return []
        try:
            return [(func, *r) for r in f(g)]
        except (P.Confusing, KeyError, ValueError, OverflowError):
            return []

    types = {"func": pa.int64()} | {c.split()[0]: KINDS[c.split()[1]] for c in schema.split(", ")}
    rows = stmts.select("func", "pos", "kind", "avar", "tree", "target", "other")
    return by_key(rows, ["pos"], run, f"func long, {schema}", types)


#: What brings a function to single assignment.
TO_SSA = [("Calls", P.collect_calls), ("Halts", P.remove_halts), ("Indirect", P.remove_indirect), ("Prune", P.prune), ("Ssa", P.to_ssa)]


def definitions(f: P.Function) -> dict:
    return {s[1]: s[2] for *_, s in f.statements() if s[0] == "move"}


def value_sets(stmts: DataFrame) -> DataFrame:
    """func, var, stride, lo, hi: all values that a variable in single assignment can have lie among lo, lo + stride, ..., hi."""
    return per_function(stmts, lambda f: [(v, x.stride, x.lo, x.hi) for v, x in sorted(M.value_sets(f).items())], "var string, stride long, lo long, hi long", TO_SSA)


def address_regions(stmts: DataFrame) -> DataFrame:
    """func, var, base, lo, hi: the only input or load that a variable leads back to, and its offsets from there; open ends are infinite."""

    def run(f):
        defs = definitions(f)
        found = ((v, R.region(v, defs)) for v in sorted(defs))
        return [(v, r[0], float(r[1]), float(r[2])) for v, r in found if r]

    return per_function(stmts, run, "var string, base string, lo double, hi double", TO_SSA)


def named_arrays(stmts: DataFrame) -> DataFrame:
    """func, array: the arrays that a function's loads and stores at known places make."""
    return per_function(stmts, lambda f: [(a,) for a in sorted(set(M.arrays(M.accesses(f)).values()))], "array string", TO_SSA)


def pointer_variables(stmts: DataFrame) -> DataFrame:
    return per_function(stmts, lambda f: [(v,) for v in sorted(R.pointers(definitions(f)))], "var string", TO_SSA)


def load_regions(stmts: DataFrame) -> DataFrame:
    """func, block, ordinal, base, lo, hi: each load by its number in its block, with the bytes it reads; base is null where that isn't known."""

    def run(f):
        defs, out = definitions(f), []
        for v in sorted(f.blocks):
            loads = [x for s in f.blocks[v] for e in s[1:] if isinstance(e, tuple) for x in walk(e) if x[0] == "load"]
            for k, x in enumerate(loads):
                r = M.address(x[2], defs)
                out.append((v, k, *((r[0], float(r[1]), float(r[2] + x[-1] // 8 - 1)) if r else (None, None, None))))
        return out

    return per_function(stmts, run, "block int, ordinal int, base string, lo double, hi double", TO_SSA)


def used_bits_table(stmts: DataFrame) -> DataFrame:
    """func, var, low, bits: the runs of bits of a variable that anything in the function uses."""
    from .expressions import bit_runs, used_bits

    def run(f):
        out: dict[str, int] = {}
        for *_, s in f.statements():
            for e in s[1:]:
                if isinstance(e, tuple):
                    used_bits(e, None, out)
        return [(v, low, n) for v in sorted(out) for low, n in bit_runs(out[v])]

    return per_function(stmts, run, "var string, low int, bits int")


def branch_flags(stmts: DataFrame) -> DataFrame:
    return per_function(stmts, lambda f: [(v, x) for v in sorted(f.blocks) for x in sorted(M.branch_flags(f, v))], "block int, var string", TO_SSA)


def exit_kinds(stmts: DataFrame) -> DataFrame:
    return per_function(stmts, lambda f: sorted(M.exit_kinds(f).items()), "block int, kind string", TO_SSA)


def post_orders(stmts: DataFrame) -> DataFrame:
    return per_function(stmts, lambda f: [(v, i) for i, v in enumerate(M.post_order(f))], "block int, step int")


def laid_out(stmts: DataFrame) -> DataFrame:
    """func, pos, kind, avar: the statements of each function's graph, in an order that gives the graph again."""
    return per_function(stmts, lambda f: [(i, s[0], s[1] if s[0] in ("label", "jmp", "call") else None) for i, s in enumerate(M.layout(f))], "pos int, kind string, avar string")


def ways_of(f: P.Function) -> dict[int, list[tuple[int, int]]]:
    """(label, next block) of each block's ways, in the order of labels."""
    return {v: [(-1 if e[2] is None else int(e[2]), e[1]) for e in f.out(v)] for v in f.blocks}


def shape_of(f: P.Function, ways: dict | None = None) -> str:
    """Equal for functions whose graphs are isomorphic with their edges' labels."""
    from .graphs import signature

    return signature(ways_of(f) if ways is None else ways, P.ENTRY)


def body_of(f: P.Function, ways: dict | None = None) -> str:
    """Equal for functions with the same graph and statements. Labels and jumps are the graph's."""
    from .graphs import preorder

    order = preorder(ways_of(f) if ways is None else ways, P.ENTRY)
    return repr([[s for s in f.blocks[v] if s[0] not in ("label", "comment", "jmp")] for v in order])


def digests(f: P.Function, passes=None) -> tuple[str, str, str | None]:
    """before, body and after of shapes; f goes through the passes."""
    import hashlib

    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()[:32]
    ways = ways_of(f)
    shape = shape_of(f, ways)
    before, body = digest(shape), digest(shape + body_of(f, ways))
    g, why = P.run_passes(f, passes)
    return before, body, None if why else digest(shape_of(g))


def shapes(stmts: DataFrame, passes=None) -> DataFrame:
    """func, before, body, after: a digest of each function's graph as it stands, of its graph with statements, and of its graph after the passes (none: the default order), all of one run; after is null where a pass can't settle the function."""
    return per_function(stmts, lambda f: [digests(f, passes)], "before string, body string, after string")


def pair_flags(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """pairs (l, r: functions) with identical, iso_before, iso_after. Identical functions aren't called isomorphic before the passes as well; a function without a shape is neither."""
    of = lambda s: shapes.select(F.col("func").alias(s), *[F.col(c).alias(f"_{s}_{c}") for c in ("before", "body", "after")])
    same = lambda c: F.coalesce(F.col(f"_l_{c}") == F.col(f"_r_{c}"), F.lit(False))
    both = pairs.join(of("l"), "l", "left").join(of("r"), "r", "left")
    return both.withColumns({"identical": same("body"), "iso_before": same("before") & ~same("body"), "iso_after": same("after")}).select(*pairs.columns, "identical", "iso_before", "iso_after")


def strided_column(op: str, a: Column, b: Column) -> Column:
    """The strided interval of an operation on two (structs stride, lo, hi of 32 bits), by arrays of a batch. Null operands give null."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        some = ~(x.isna().any(axis=1) | y.isna().any(axis=1)).to_numpy()
        of = lambda t: tuple(t[c].to_numpy()[some].astype("int64") for c in ("stride", "lo", "hi"))
        out = pd.DataFrame({c: pd.Series(pd.NA, index=x.index, dtype="Int64") for c in ("stride", "lo", "hi")})
        for c, v in zip(out.columns, N.columns(op, of(x), of(y))):
            out.loc[some, c] = v
        return out

    return F.pandas_udf(run, "stride long, lo long, hi long")(a, b)


# Tables alone


def numbered_variables(rows: DataFrame, name: str = "var") -> DataFrame:
    """rows with id: one number for each name of a function, in the order of names, from 1. Null names have none."""
    return rows.withColumn("id", F.when(F.col(name).isNotNull(), F.dense_rank().over(Window.partitionBy("func").orderBy(F.col(name).asc_nulls_last()))))


def memory_ordinals(rows: DataFrame, is_memory: Column) -> DataFrame:
    """rows (func, pos) with ordinal: the number of a memory operation in its function, from 0; null for other statements."""
    w = Window.partitionBy("func").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ordinal", F.when(is_memory, F.count_if(is_memory).over(w) - 1))


def transferred(old: DataFrame, new: DataFrame) -> DataFrame:
    """func, ordinal, id, reason: ids of new's memory operations (func, ordinal, id) on old's (func, ordinal); a function whose numbers of them differ has one row, with the reason."""
    n = old.groupBy("func").agg(F.count("*").alias("_a")).join(new.groupBy("func").agg(F.count("*").alias("_b")), "func", "full")
    bad = n.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("func", F.lit(None).cast("long").alias("ordinal"), F.lit(None).cast("long").alias("id"), F.lit("memory operations differ").alias("reason"))
    both = old.select("func", "ordinal").join(new.select("func", "ordinal", "id"), ["func", "ordinal"]).join(bad.select("func"), "func", "left_anti")
    return both.select("func", F.col("ordinal").cast("long").alias("ordinal"), F.col("id").cast("long").alias("id"), F.lit(None).cast("string").alias("reason")).unionByName(bad)


def call_graph(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """caller, callee, n: calls (func, target: a name) between functions (func, symbol); a name that no function has is unknown (callee null)."""
    by_name = functions.select(F.col("symbol").alias("target"), F.col("func").alias("callee"))
    return sites.join(by_name, "target", "left").groupBy(F.col("func").alias("caller"), "callee").agg(F.count("*").alias("n"))


def with_heights(sites: DataFrame, steps: DataFrame) -> DataFrame:
    """sites (func, pos) with height: the sum of the function's stack adjustments (func, pos, step) before the call; null from an unknown one (null step) on."""
    rows = steps.select("func", "pos", "step", F.lit(False).alias("_site")).unionByName(sites.select("func", "pos", F.lit(0).alias("step"), F.lit(True).alias("_site")))
    w = Window.partitionBy("func").orderBy("pos", F.col("_site").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lost = F.coalesce(F.max(F.col("step").isNull()).over(w), F.lit(False))
    h = rows.withColumn("height", F.when(~lost, F.coalesce(F.sum("step").over(w), F.lit(0)))).where("_site")
    return h.select("func", "pos", "height")


def exit_heights(heights: DataFrame, most: int = 4) -> DataFrame:
    """func, height, well_behaved: the one height that all exits of a function have (func, height), null where they differ, are unknown, or exceed the most allowed."""
    g = heights.groupBy("func").agg(F.min("height").alias("_lo"), F.max("height").alias("_hi"), F.count("*").alias("_n"), F.count("height").alias("_k"))
    ok = (F.col("_lo") == F.col("_hi")) & (F.col("_n") == F.col("_k")) & (F.col("_hi") <= most)
    ok = F.coalesce(ok, F.lit(False))
    return g.select("func", F.when(ok, F.col("_hi")).alias("height"), ok.alias("well_behaved"))


def kill_summaries(calls: DataFrame, own: DataFrame) -> DataFrame:
    """func, kill: what a function may overwrite, itself (func, kill) or by those it calls (caller, callee; null: unknown, which overwrites all). Kills of one kind go where all of the kind are: all_regs over reg:, all_memory over the rest."""
    unknown = calls.where("callee is null").select(F.col("caller").alias("func"), F.explode(F.array(F.lit("all_regs"), F.lit("all_memory"))).alias("kill"))
    start = own.select("func", "kill").unionByName(unknown)
    back = calls.where("callee is not null").select(F.col("callee").alias("func"), "caller").distinct()
    every = fixpoint(start, lambda new: new.join(back, "func").select(F.col("caller").alias("func"), "kill"))
    flags = every.groupBy("func").agg(F.bool_or(F.col("kill") == "all_regs").alias("_r"), F.bool_or(F.col("kill") == "all_memory").alias("_m"))
    reg = F.col("kill").startswith("reg:")
    special = F.col("kill").isin("all_regs", "all_memory")
    return every.join(flags, "func").where(special | (reg & ~F.col("_r")) | (~reg & ~F.col("_m"))).select("func", "kill")


def undefined_after_calls(sites: DataFrame, loads: DataFrame, saved: tuple[str, ...] = M.CALLER_SAVED) -> DataFrame:
    """func, pos, var: what a straight-line function's calls (func, pos) leave undefined: the registers that callers save, and memory if a load (func, pos) follows."""
    last = loads.groupBy("func").agg(F.max("pos").alias("_last"))
    regs = sites.select("func", "pos", F.explode(F.array(*[F.lit(r) for r in saved])).alias("var"))
    return regs.unionByName(sites.join(last, "func").where("pos < _last").select("func", "pos", F.lit("mem").alias("var")))


def block_bounds(rows: DataFrame) -> DataFrame:
    """func, block, first_addr, last_addr: the first and the last statement of a block (func, block, pos, addr) that has an address; null in a block without one."""
    at = F.when(F.col("addr").isNotNull(), F.struct("pos", "addr"))
    return rows.groupBy("func", "block").agg(F.min(at)["addr"].alias("first_addr"), F.max(at)["addr"].alias("last_addr"))


def calls_at_ends(bounds: DataFrame, sites: DataFrame) -> DataFrame:
    """func, block, callee of blocks whose last address is a call's site (func, site, callee)."""
    return bounds.join(sites.select("func", F.col("site").alias("last_addr"), "callee"), ["func", "last_addr"]).select("func", "block", "callee")


def split_after_calls(rows: DataFrame, is_call: Column, addr: str = "addr") -> DataFrame:
    """rows (func, pos) with block: a new one starts at the first statement after a call whose address is another than the call's."""
    w = Window.partitionBy("func").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("_a", F.last(addr, ignorenulls=True).over(upto))
    run = run.withColumn("_c", F.last(F.when(is_call, F.struct("pos", "_a")), ignorenulls=True).over(back))
    # Between a call and the statement that starts the next block all addresses are the call's.
    moved = run.withColumn("_m", F.coalesce((F.col("_a") != F.col("_c._a")), F.lit(False)))
    first = moved.withColumn("_f", F.when(F.col("_m") & ~F.coalesce(F.lag("_m").over(w) & F.lag("_c.pos").over(w).eqNullSafe(F.col("_c.pos")), F.lit(False)), 1).otherwise(0))
    return first.withColumn("block", F.sum("_f").over(upto)).drop("_a", "_c", "_m", "_f")


def aliases(base1: Column, lo1: Column, hi1: Column, base2: Column, lo2: Column, hi2: Column) -> Column:
    """Whether two accesses can meet: bytes of one base overlap or not; of two bases, or of an unknown one, that isn't known (null)."""
    return F.when(base1 == base2, (lo1 <= hi2) & (lo2 <= hi1))


def frame_code(asm: Column, ordinal: Column, first: int = 3) -> Column:
    """prologue or epilogue, by the text of one of a function's first statements or of a return sequence; else null."""
    return F.when((ordinal <= first) & asm.rlike(r"^\s*(push\s+%?e?bp|mov\s+%?esp\s*,\s*%?ebp|sub\s+.*%?esp)"), "prologue").when(asm.rlike(r"^\s*(leave|pop\s+%?ebp|ret)\b"), "epilogue")


def contexts(rows: DataFrame) -> DataFrame:
    """addr, contexts: the distinct contexts (name, value) that an address was seen in, in order, as text."""
    return rows.groupBy("addr").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "name", "value"))), "; ").alias("contexts"))


#: How functions are compared; one way exists.
STRATEGIES = ("combinatorial",)


def strategy(name: str) -> str:
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name}")
    return name
