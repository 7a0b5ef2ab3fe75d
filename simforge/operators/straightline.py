"""Windows over the statements (func, pos, avar, op, a, b) of functions: avar := op(a, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upto():
    return Window.partitionBy("func").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def before():
    return Window.partitionBy("func").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def after():
    return Window.partitionBy("func").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)


def load_ordinals(stmt: DataFrame) -> DataFrame:
    """Each load's number in its function, from 0."""
    return stmt.withColumn("ordinal", F.sum(F.when(F.col("op") == "load", 1).otherwise(0)).over(upto()) - 1).where("op = 'load'")


def running_height(stmt: DataFrame, step: Column, unknown: Column) -> DataFrame:
    """The sum of steps so far, null from the first unknown one on."""
    lost = F.max(F.when(unknown, 1).otherwise(0)).over(upto())
    return stmt.withColumn("height", F.when(lost == 0, F.sum(step).over(upto())))


def last_definitions(stmt: DataFrame) -> DataFrame:
    """Each use of a with the position of the last statement before it that defines it; null if it comes from outside."""
    rows = stmt.select("func", "pos", F.col("a").alias("var"), F.lit(None).cast("long").alias("def")).unionByName(stmt.select("func", (F.col("pos")).alias("pos"), F.col("avar").alias("var"), F.col("pos").cast("long").alias("def")))
    w = Window.partitionBy("func", "var").orderBy("pos", F.col("def").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("from_pos", F.last("def", ignorenulls=True).over(w)).where("def is null").select("func", "pos", "var", "from_pos")


def inputs(stmt: DataFrame) -> DataFrame:
    """func, var of variables that are used and never defined."""
    return stmt.select("func", F.col("a").alias("var")).distinct().join(stmt.select("func", F.col("avar").alias("var")).distinct(), ["func", "var"], "left_anti")


def carried(stmt: DataFrame) -> DataFrame:
    """func, var of variables that are used before or at their first definition."""
    use = stmt.groupBy("func", F.col("a").alias("var")).agg(F.min("pos").alias("use"))
    define = stmt.groupBy("func", F.col("avar").alias("var")).agg(F.min("pos").alias("def"))
    return use.join(define, ["func", "var"]).where("use <= def").select("func", "var")


def live_at_end(stmt: DataFrame) -> DataFrame:
    """The last definition of each variable of a function."""
    w = Window.partitionBy("func", "avar").orderBy(F.col("pos").desc())
    return stmt.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def killed(stmt: DataFrame) -> DataFrame:
    """Definitions that a later one of the same variable replaces, with where."""
    return stmt.withColumn("by_pos", F.lead("pos").over(Window.partitionBy("func", "avar").orderBy("pos"))).where("by_pos is not null")


def remaining(stmt: DataFrame) -> DataFrame:
    """How many loads are left after each statement."""
    return stmt.withColumn("loads_left", F.coalesce(F.count_if(F.col("op") == "load").over(after()), F.lit(0)))


def pieces(stmt: DataFrame, ends: Column) -> DataFrame:
    """A block number for each statement: a block ends with a statement where `ends` holds."""
    return stmt.withColumn("block", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(before()), F.lit(0)))


def def_ref(stmt: DataFrame) -> DataFrame:
    """Sorted distinct variables that a function defines and refers to."""
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return stmt.groupBy("func").agg(join("avar").alias("defs"), join("a").alias("refs"))


def dead_code(stmt: DataFrame) -> DataFrame:
    """Statements that nothing live needs. The last definition of each variable and all stores are live, and so is what they use, and so on: back from the end, one pass over each function tells."""
    import pyarrow as pa

    from .tables import by_key

    def run(func, rows: list[tuple]) -> list[tuple]:
        needed, ended, dead = set(), set(), []
        for row in reversed(rows):
            _, _, avar, op, a, _ = row
            if op != "store" and avar in ended and avar not in needed:
                dead.append(row)
                continue
            needed.discard(avar)
            ended.add(avar)
            needed.add(a)
        return dead

    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    rows = stmt.select("func", "pos", "avar", "op", "a", "b")
    return by_key(rows, ["pos"], run, ", ".join(f"{c} {t}" for c, t in rows.dtypes), {c: kinds[t] for c, t in rows.dtypes})


def collapsible_loads(stmt: DataFrame) -> DataFrame:
    """Loads whose variable a store defined last, with that store."""
    stores = stmt.where("op = 'store'").select("func", F.col("pos").alias("from_pos"))
    return last_definitions(stmt).join(stmt.where("op = 'load'").select("func", "pos"), ["func", "pos"]).join(stores, ["func", "from_pos"]).select("func", "pos", "from_pos")


def identity(stmt: DataFrame) -> DataFrame:
    """func, shape, n: equal for functions whose statements are equal but for the names of variables, which are numbered as they appear."""
    seq = F.array_sort(F.collect_list(F.struct("pos", "avar", "op", "a", "b")))
    names = lambda s: F.array_distinct(F.flatten(F.transform(s, lambda x: F.array(x["a"], x["avar"]))))
    shape = lambda s, n: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.array_position(n, x["avar"]).cast("string"), x["op"], F.array_position(n, x["a"]).cast("string"), x["b"].cast("string"))), ";")
    g = stmt.groupBy("func").agg(seq.alias("_s")).withColumn("_n", names(F.col("_s")))
    return g.select("func", shape(F.col("_s"), F.col("_n")).alias("shape"), F.size("_s").alias("n"))


def common_prefix(lists: DataFrame, by: str, items: str) -> DataFrame:
    """by, length of the longest common prefix of the arrays of a group."""
    n = lists.groupBy(by).agg(F.count("*").alias("_n"))
    at = lists.select(by, F.posexplode(items).alias("_i", "_x")).groupBy(by, "_i").agg(F.count("*").alias("_k"), F.count_distinct("_x").alias("_d"))
    ok = at.join(n, by).where("_k = _n and _d = 1")
    w = Window.partitionBy(by).orderBy("_i")
    run = ok.withColumn("_r", F.row_number().over(w) - 1).where("_r = _i").groupBy(by).agg(F.count("*").alias("length"))
    return n.join(run, by, "left").select(by, F.coalesce("length", F.lit(0)).alias("length"))


def pair_verdicts(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """func, verdict of each pair of functions under one number: identical, or where the first statement stands that differs in the columns or that one side lacks."""
    a = left.select("func", "pos", F.struct(*columns).alias("_l"))
    b = right.select("func", "pos", F.struct(*columns).alias("_r"))
    same = F.col("_l").eqNullSafe(F.col("_r"))
    g = a.join(b, ["func", "pos"], "full").groupBy("func").agg(F.min(F.when(~same, F.col("pos"))).alias("_at"))
    return g.select("func", F.when(F.col("_at").isNull(), "identical").otherwise(F.concat(F.lit("differ at "), F.col("_at").cast("string"))).alias("verdict"))
