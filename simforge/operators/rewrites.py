"""Rewrites of control-flow graphs as tables, over all functions at once.

Statements are rows (graph, block, pos, ...), edges (graph, src, dst, label), as
graphs takes them. A statement with a null graph, block or position, and an edge
with a null end, takes no part. An empty table gives an empty one. A block's
statements are numbered in windows by block, so a long function is spread over
tasks by its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import reachable_only

#: Statements that do something or lead somewhere.
CODE = ("move", "jmp", "cjmp", "halt")


def _placed(stmts: DataFrame) -> DataFrame:
    return stmts.where("graph is not null and block is not null and pos is not null")


def _whole(edges: DataFrame) -> DataFrame:
    return edges.where("graph is not null and src is not null and dst is not null")


def block_facts(stmts: DataFrame) -> DataFrame:
    """graph, block, is_nop (nothing but labels, calls and comments), has_code, only_halts (nothing but halts, labels and comments), ends_in_halt, n_labels (a label stands for an instruction's address), of statements with kind."""
    kind, code = F.col("kind"), F.col("kind").isin(*CODE)
    g = _placed(stmts).groupBy("graph", "block").agg(
        F.count_if(code).alias("_code"), F.count_if(~kind.isin("halt", "comment", "label")).alias("_other"), F.max_by("kind", "pos").alias("_last"), F.count_if(kind == "label").alias("n_labels"),
    )
    return g.select("graph", "block", (F.col("_code") == 0).alias("is_nop"), (F.col("_code") > 0).alias("has_code"), (F.col("_other") == 0).alias("only_halts"), (F.col("_last") == "halt").alias("ends_in_halt"), "n_labels")


def piece(block: Column, k: Column) -> Column:
    """The name of a block's k-th piece; the first keeps the block's."""
    return F.when(k == 0, block.cast("string")).otherwise(F.concat(block.cast("string"), F.lit("+"), k.cast("string")))


def broken_after_calls(stmts: DataFrame, edges: DataFrame, is_call: Column) -> tuple[DataFrame, DataFrame]:
    """(statements, edges) where a block ends with each call: blocks are text, edges in lead to a block's first piece, edges out come from its last, and pieces follow each other."""
    before = Window.partitionBy("graph", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = _placed(stmts)
    rows = placed.withColumn("_k", F.coalesce(F.count_if(is_call).over(before), F.lit(0)))
    # A block's last piece is known by its number of calls alone, less one that is its last statement; no order is needed for it.
    last = placed.groupBy("graph", "block").agg((F.count_if(is_call) - F.max_by(F.coalesce(is_call, F.lit(False)), "pos").cast("long")).alias("_last"))
    e = _whole(edges).select("graph", "src", "dst", "label").join(last.withColumnRenamed("block", "src"), ["graph", "src"], "left")
    e = e.select("graph", piece(F.col("src"), F.coalesce("_last", F.lit(0))).alias("src"), F.col("dst").cast("string").alias("dst"), "label")
    steps = last.where("_last > 0").select("graph", "block", F.explode(F.sequence(F.lit(1).cast("long"), "_last")).alias("_k"))
    steps = steps.select("graph", piece(F.col("block"), F.col("_k") - 1).alias("src"), piece(F.col("block"), F.col("_k")).alias("dst"), F.lit(None).cast("boolean").alias("label"))
    return rows.withColumn("block", piece(F.col("block"), F.col("_k"))).drop("_k"), e.unionByName(steps)


def without_returns(edges: DataFrame, endless: DataFrame, starts: DataFrame) -> DataFrame:
    """edges without those that go on after a call that doesn't return (endless: graph, v, the blocks that end in one; their labelled edges stay), and without what the starts (graph, v) then don't reach."""
    gone = endless.select("graph", F.col("v").alias("src")).distinct().withColumn("_gone", F.lit(True))
    left = _whole(edges).join(gone, ["graph", "src"], "left").where("_gone is null or label is not null").drop("_gone")
    return reachable_only(left, starts).select("graph", "src", "dst", "label")


NOT, UNEQUAL, EQUAL = '["un","~",', '["bin","!=",', '["bin","==",'


def peeled(condition: Column) -> tuple[Column, Column]:
    """(condition without negations around it, and as an equality where it was an inequality; how many negations went) of a tree as text."""
    chain = F.length(F.regexp_extract(condition, r'^((?:\["un","~",)*)', 1)) / F.lit(len(NOT))
    chain = chain.cast("int")
    inner = F.substring(condition, chain * len(NOT) + 1, F.length(condition) - chain * (len(NOT) + 1))
    unequal = inner.startswith(UNEQUAL)
    return F.when(unequal, F.concat(F.lit(EQUAL), F.substring(inner, F.lit(len(UNEQUAL) + 1), F.length(inner)))).otherwise(inner), chain + unequal.cast("int")


def normal_branches(branches: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(branches, edges): conditions (graph, block, condition) without negations; an odd number of them swaps the labels of the block's edges."""
    plain, n = peeled(F.col("condition"))
    odd = branches.where(n % 2 == 1).select("graph", F.col("block").alias("src")).distinct().withColumn("_odd", F.lit(True))
    e = edges.join(odd, ["graph", "src"], "left").select("graph", "src", "dst", F.when(F.col("_odd"), ~F.col("label")).otherwise(F.col("label")).alias("label"))
    return branches.withColumn("condition", plain), e


def single_exit(stmts: DataFrame, edges: DataFrame, leave: str = "exit", tail: str = "tail") -> tuple[DataFrame, DataFrame]:
    """(statements, edges) where a graph with several blocks before its exit has one: what they all end with, text by text (graph, block, pos, text), moves to a new block, through which they leave.

    A block that leaves with nothing of its own leaves no statements; where the ends
    have nothing in common the new block is empty. Graphs with one way out stay.
    """
    e = _whole(edges).select("graph", "src", "dst", "label")
    ends = e.where(F.col("dst") == leave).select("graph", F.col("src").alias("block")).distinct()
    many = ends.groupBy("graph").agg(F.count("*").alias("_m")).where("_m > 1")
    rows = _placed(stmts).select("graph", "block", "pos", "text")
    back = Window.partitionBy("graph", "block").orderBy(F.desc("pos"))
    # Statements meet their block's columns only, as few graphs can have many of them, and in the window's order.
    last = rows.withColumn("_k", F.row_number().over(back))
    # The k-th statement from the end is common if all ends have it, and so are those behind it. Texts that are alike are counted before they are compared.
    alike = last.join(ends.join(many, "graph"), ["graph", "block"]).groupBy("graph", "_m", "_k", "text").agg(F.count("*").alias("_c"))
    at = alike.groupBy("graph", "_m", "_k").agg(F.sum("_c").alias("_n"), F.min("text").alias("_lo"), F.max("text").alias("_hi"), F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.col("_c"))), F.lit(0)).alias("_t"))
    same = (F.col("_n") == F.col("_m")) & F.col("_lo").eqNullSafe(F.col("_hi")) & ((F.col("_t") == 0) | (F.col("_t") == F.col("_n")))
    run = Window.partitionBy("graph").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    common = at.withColumn("_ok", F.min(same.cast("int")).over(run)).where("_ok = 1").select("graph", "_k", F.col("_lo").alias("text"))
    length = common.groupBy("graph").agg(F.max("_k").alias("_length"))
    moved = common.select("graph", F.lit(tail).alias("block"), (-F.col("_k")).cast("long").alias("pos"), "text")
    kept = last.join(ends.join(length, "graph"), ["graph", "block"], "left").where("_length is null or _k > _length").select("graph", "block", F.col("pos").cast("long").alias("pos"), "text")
    to = e.join(many.select("graph", F.lit(True).alias("_many")), "graph", "left")
    to = to.select("graph", "src", F.when(F.col("_many") & (F.col("dst") == leave), tail).otherwise(F.col("dst")).alias("dst"), "label")
    new = many.select("graph", F.lit(tail).alias("src"), F.lit(leave).alias("dst"), F.lit(None).cast("boolean").alias("label"))
    return kept.unionByName(moved), to.unionByName(new)


def plausible_sinks(steps: DataFrame) -> DataFrame:
    """graph, var, sink, reason: where a variable can lead, of the ways (graph, var, way, sink, is_pointer: of a variable on the way, null where that isn't known).

    A way with a variable that is no pointer isn't one. A variable that then has two
    sinks that are pointers has no sink, and a reason.
    """
    ways = steps.where("graph is not null and var is not null and way is not null").groupBy("graph", "var", "way").agg(F.max("sink").alias("sink"), F.count_if(~F.col("is_pointer")).alias("_no"), F.count_if("is_pointer").alias("_yes")).where("_no = 0")
    sinks = ways.groupBy("graph", "var", "sink").agg(F.max(F.col("_yes") > 0).alias("_sure"))
    n = sinks.groupBy("graph", "var").agg(F.count_if("_sure").alias("_n"), F.collect_list(F.struct("sink")).alias("_s"))
    one = n.where("_n < 2").select("graph", "var", F.inline("_s")).withColumn("reason", F.lit(None).cast("string"))
    return one.unionByName(n.where("_n >= 2").select("graph", "var", F.lit(None).cast(dict(steps.dtypes)["sink"]).alias("sink"), F.lit("several pointers").alias("reason")))
