"""Pairs of subjects, and clusters of equivalent ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPILERS = ("clang", "gcc")


def subject_key(s: str = "") -> Column:
    """case-compiler-version-olevel-symbol, without the address."""
    c = lambda n: F.col(f"{s}{n}")
    return F.concat_ws("-", c("prim"), c("compiler"), c("version"), c("olevel"), c("symbol"))


def subject_name(s: str = "") -> Column:
    return F.concat_ws("-", subject_key(s), F.concat(F.lit("0x"), F.lower(F.hex(F.col(f"{s}addr")))))


def parse_subject(text: Column) -> dict[str, Column]:
    """Fields of a subject's name; null where it is malformed."""
    pattern = r"^(.+?)-(clang|gcc)-(\d+)[^\w](\d+)[^\w](\d+)-([A-Za-z0-9_]+)-(.+)-0x([0-9a-f]+)$"
    ok = text.rlike(pattern)
    g = lambda k: F.when(ok, F.regexp_extract(text, pattern, k))
    return {"prim": g(1), "compiler": g(2), "version": F.when(ok, F.concat_ws(".", g(3), g(4), g(5))), "olevel": g(6), "symbol": g(7), "addr": F.conv(g(8), 16, 10).cast("long")}


def parse_cluster(text: Column) -> Column:
    """The two names of a cluster key, null unless there are exactly two."""
    parts = F.split(text, "--")
    return F.when(F.size(parts) == 2, parts)


def matching_versions(df: DataFrame, compiler: str | None = None, version: str | None = None) -> DataFrame:
    """Subjects of a compiler by name and of a version by a pattern that is anchored at its start."""
    if version is not None and compiler is None:
        raise ValueError("a version needs a compiler")
    if compiler is not None:
        df = df.where(F.col("compiler") == compiler)
    return df if version is None else df.where(F.col("version").rlike(f"^(?:{version})"))


def adjacent(df: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """by, l, r: each item and the next one of its group."""
    return df.withColumn("_r", F.lead(item).over(Window.partitionBy(*by).orderBy(*order))).where("_r is not null").select(*by, F.col(item).alias("l"), F.col("_r").alias("r"))


def unordered(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, l, r: each pair of different items of a group once. The result itself is quadratic in a group, as asked for."""
    other = df.select(*by, F.col(item).alias("r"))
    return df.select(*by, F.col(item).alias("l")).join(other, by).where("l < r")


def disjoint(df: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """by, l, r: the first item with the second, the third with the fourth. A group of odd size ends the job."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = df.withColumn("_k", F.floor((F.row_number().over(w) - 1) / 2))
    g = n.groupBy(*by, "_k").agg(F.count("*").alias("_n"), F.min_by(item, F.struct(*order)).alias("l"), F.max_by(item, F.struct(*order)).alias("r"))
    return g.select(*by, "l", F.when(F.col("_n") == 2, F.col("r")).otherwise(F.raise_error(F.lit("odd number of items"))).alias("r"))


def tagged(pairs: DataFrame) -> DataFrame:
    """item, tag: both items of a pair under the pair's name."""
    tag = F.concat_ws("--", F.col("l").cast("string"), F.col("r").cast("string"))
    return pairs.select(F.explode(F.array("l", "r")).alias("item"), tag.alias("tag"))


def measure_vector(*measures: Column) -> Column:
    """Measures mod 64, eight bits each, first one lowest."""
    out = F.lit(0).cast("long")
    for i, m in enumerate(measures):
        out = out.bitwiseOR(F.shiftleft((m % 64).cast("long"), 8 * i))
    return out


def normal_identifiers(text: Column, pattern: str) -> Column:
    """text with each distinct match of pattern replaced by _k, k counting from 1 as they first appear."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    marked = F.split(F.regexp_replace(text, f"({pattern})", "\u0001$1\u0001"), "\u0001")
    parts = lambda ms, ids: F.array_join(F.transform(ms, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("_"), F.array_position(ids, x).cast("string"))).otherwise(x)), "")
    # The one-element array binds the ids to a name, so that they are found once.
    return F.element_at(F.transform(F.array(found), lambda ids: parts(marked, ids)), 1)


def staged(df: DataFrame, *keys: Column) -> DataFrame:
    """One row: the number of items, and of classes after each stage of equivalence, each refining over the classes of the one before by its own key."""
    return df.agg(F.count("*").alias("n_initial"), *[F.count_distinct(k).alias(f"n_stage_{i + 1}") for i, k in enumerate(keys)])


def symmetric(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row for each unordered pair."""
    return df.withColumns({"_l": F.least(a, b), "_r": F.greatest(a, b)}).dropDuplicates(["_l", "_r"]).drop("_l", "_r")


def greedy_buckets(items: list, same) -> list[list]:
    """Each item goes to the first bucket whose first item it equals, or opens one."""
    out: list[list] = []
    for x in items:
        for b in out:
            if same(b[0], x):
                b.append(x)
                break
        else:
            out.append([x])
    return out


def reduce_buckets(items: list, same, least: int = 8) -> list[list]:
    """Halves are reduced by themselves, then one's buckets join the other's."""
    if len(items) <= least:
        return greedy_buckets(items, same)
    m = len(items) // 2
    left = reduce_buckets(items[:m], same, least)
    for b in reduce_buckets(items[m:], same, least):
        for a in left:
            if same(a[0], b[0]):
                a.extend(b)
                break
        else:
            left.append(b)
    return left


def bucket_table(items: DataFrame, same) -> DataFrame:
    """grp, first, item, value: items (grp, item, value) in buckets of equal values, each named by its smallest item. same(a, b) compares values; a group's items come in order, and each is held against the first value of every bucket so far, so a call holds one group."""
    import pyarrow as pa

    from .tables import by_key

    def run(grp, rows: list[tuple]) -> list[tuple]:
        return [(grp, b[0][1], item, value) for b in reduce_buckets(rows, lambda x, y: same(x[2], y[2])) for _, item, value in b]

    return by_key(items.select("grp", "item", "value"), ["item"], run, "grp long, first long, item long, value long", dict.fromkeys(("grp", "first", "item", "value"), pa.int64()))


def shared_names(df: DataFrame, item: str, name: str) -> DataFrame:
    """item, same: the smallest item that is linked to it by names they share, directly or by way of others. Every item of a name is linked to the name's smallest, so a name on very many items gives as many links."""
    from .components import components

    low = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(item).alias("b"))
    links = df.join(low, name).select(F.col(item).alias("a"), "b").where("a != b")
    found = components(links).withColumnRenamed("item", item)
    return df.select(item).distinct().join(found, item, "left").select(item, F.coalesce("same", item).alias("same"))


def resolved_calls(sites: DataFrame, functions: DataFrame, plt: DataFrame) -> DataFrame:
    """site, target of each call (site, addr): the function that starts there, else the linkage entry, else unknown at that address."""
    f = functions.select(F.col("start").alias("addr"), F.col("symbol").alias("_f"))
    p = plt.select("addr", F.col("symbol").alias("_p"))
    unknown = F.concat(F.lit("unknown@"), F.col("addr").cast("string"))
    return sites.join(f, "addr", "left").join(p, "addr", "left").select("site", F.coalesce("_f", "_p", unknown).alias("target"))


def in_ground_truth(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs (caller, callee) with hit: whether an instance has a caller range and a callee range that start there (caller_ranges, callee_ranges)."""
    t = truth.select(F.explode("caller_ranges").alias("a"), "callee_ranges").select(F.col("a.lo").alias("caller"), F.explode("callee_ranges").alias("b")).select("caller", F.col("b.lo").alias("callee")).distinct()
    return pairs.join(t.withColumn("_h", F.lit(True)), ["caller", "callee"], "left").withColumn("hit", F.coalesce("_h", F.lit(False))).drop("_h")


def bucket_match(left: DataFrame, right: DataFrame, by: str, bounds: list[str]) -> DataFrame:
    """by, matched: whether both sides have the same number of arrays of every bounds."""
    a = left.groupBy(by, *bounds).agg(F.count("*").alias("_a"))
    b = right.groupBy(by, *bounds).agg(F.count("*").alias("_b"))
    return a.join(b, [by, *bounds], "full").groupBy(by).agg(F.bool_and(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).alias("matched"))
