"""What is to be compared: parsed subjects, batches and their manifests, and results joined to the plan.

Null fields make a subject null; empty tables give empty tables. Operators that
add columns take the caller's columns along unchanged and name their own in the
docstring; a column of the caller by such a name is an error of the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Optimisation levels that every pair of versions is compared at, and bytes of a path component.
OLEVELS = ("O0", "O1", "O2", "O3", "Os")
NAME_MAX = 250

_BINARY = r"^(clang|gcc)-(\d+[^-]\d+[^-]\d+)-([A-Za-z0-9_]+)-([^-]+)"


def _fields(text: Column, pattern: str, names: tuple[str, ...]) -> Column:
    """A struct of a pattern's groups; null where the text has another form."""
    return F.when(text.rlike(pattern), F.struct(*[F.regexp_extract(text, pattern, i + 1).alias(n) for i, n in enumerate(names)]))


def of_key(key: Column) -> Column:
    """case, compiler, version, olevel, symbol of a key's five fields between dashes, address 0 and the path that they make; null unless there are five."""
    s = _fields(key, r"^([^-]+)-([^-]+)-([^-]+)-([^-]+)-([^-]+)$", ("prim", "compiler", "version", "olevel", "symbol"))
    path = F.concat_ws("-", s["compiler"], s["version"], s["prim"], s["olevel"])
    return F.when(s.isNotNull(), F.struct(*[s[n].alias(n) for n in ("prim", "compiler", "version", "olevel", "symbol")], F.lit(0).cast("long").alias("addr"), path.alias("path")))


def of_binary(path: Column, symbol: Column, addr: Column) -> Column:
    """The subject of a function of a binary whose base name is compiler-version-olevel-case."""
    s = _fields(F.substring_index(path, "/", -1), _BINARY, ("compiler", "version", "olevel", "prim"))
    return F.when(s.isNotNull(), F.struct(*[s[n].alias(n) for n in ("prim", "compiler", "version", "olevel")], symbol.alias("symbol"), addr.cast("long").alias("addr"), path.alias("path")))


def last_fields(text: Column) -> Column:
    """prog, symbol, addr of `prog-symbol-hex`, where prog itself may hold dashes."""
    s = _fields(text, r"^(.+)-([^-]+)-([0-9a-fA-F]+)$", ("prog", "symbol", "addr"))
    return F.when(s.isNotNull(), F.struct(s["prog"].alias("prog"), s["symbol"].alias("symbol"), F.conv(s["addr"], 16, 10).cast("long").alias("addr")))


def hexadecimal(addr: Column) -> Column:
    return F.lower(F.hex(addr))


def pair_tag(l_bin: Column, l_name: Column, l_addr: Column, r_bin: Column, r_name: Column, r_addr: Column) -> Column:
    """binary-name-address of both sides, in hex."""
    return F.concat_ws("--", F.concat_ws("-", l_bin, l_name, hexadecimal(l_addr)), F.concat_ws("-", r_bin, r_name, hexadecimal(r_addr)))


def function_dir(name: Column, addr: Column, most: int = NAME_MAX) -> Column:
    """name-address, the name cut so that the whole has `most` bytes at most and still ends with the address."""
    tail = F.concat(F.lit("-"), hexadecimal(addr))
    return F.concat(F.substring(name.cast("binary"), F.lit(1), F.lit(most) - F.octet_length(tail)).cast("string"), tail)


def selected(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose value is in the list; an empty list keeps all."""
    return df.where(F.col(column).isin(names)) if names else df


def by_version(df: DataFrame, grouping: str) -> DataFrame:
    """df with group: the major version (a.b), or one for all."""
    if grouping not in ("major", "all"):
        raise ValueError(f"no grouping by {grouping}")
    return df.withColumn("group", F.substring_index("version", ".", 2) if grouping == "major" else F.lit("All"))


def version_pairs(subjects: DataFrame, grouping: str = "major", mode: str = "adjacent") -> DataFrame:
    """compiler, group, l, r: pairs of a compiler's versions within a group, each with the next one or with every later one. Versions go by their numbers."""
    key = F.transform(F.split("version", r"\."), lambda x: x.cast("int"))
    v = by_version(subjects.select("compiler", "version").distinct(), grouping).withColumn("_k", key)
    if mode == "adjacent":
        w = Window.partitionBy("compiler", "group").orderBy("_k")
        return v.withColumn("r", F.lead("version").over(w)).where("r is not null").select("compiler", "group", F.col("version").alias("l"), "r")
    if mode != "unique":
        raise ValueError(f"no pairs by {mode}")
    other = v.select("compiler", "group", F.col("version").alias("r"), F.col("_k").alias("_q"))
    return v.join(other, ["compiler", "group"]).where("_k < _q").select("compiler", "group", F.col("version").alias("l"), "r")


def batch_pairs(pairs: DataFrame, primitives: DataFrame, binaries: DataFrame, symbols: DataFrame) -> DataFrame:
    """The functions to compare: for each pair of versions (compiler, group, l, r), each level and each implementation of a primitive (prim, implementation) where both binaries (prim, compiler, version, olevel, path) are there.

    Columns: prim, compiler, olevel, implementation, symbol (implementation_prim),
    l_version, r_version, l_path, r_path, l_addr, r_addr, batch (the file's path).
    symbols: path, symbol, addr; a binary without the symbol gives no pair.
    """
    side = lambda x: binaries.select("prim", "compiler", "olevel", F.col("version").alias(f"{x}_version"), F.col("path").alias(f"{x}_path"))
    both = pairs.select("compiler", F.col("l").alias("l_version"), F.col("r").alias("r_version")).join(side("l"), ["compiler", "l_version"]).join(side("r"), ["prim", "compiler", "olevel", "r_version"]).where(F.col("olevel").isin(*OLEVELS))
    named = both.join(primitives, "prim").withColumn("symbol", F.concat_ws("_", "implementation", "prim"))
    at = lambda x: symbols.select(F.col("path").alias(f"{x}_path"), "symbol", F.col("addr").alias(f"{x}_addr"))
    out = named.join(at("l"), ["l_path", "symbol"]).join(at("r"), ["r_path", "symbol"])
    return out.withColumn("batch", batch_path()).select("prim", "compiler", "olevel", "implementation", "symbol", "l_version", "r_version", "l_path", "r_path", "l_addr", "r_addr", "batch")


def batch_path() -> Column:
    side = lambda v: F.concat_ws("-", "compiler", v, "olevel")
    return F.concat(F.col("prim"), F.lit("/"), side("l_version"), F.lit("_vs_"), side("r_version"), F.lit("-"), F.col("prim"), F.lit(".batch"))


def manifest(pairs: DataFrame) -> DataFrame:
    """side, implementation, prim, compiler, version, olevel, path: a left and a right row for each pair of batch_pairs."""
    side = lambda x: F.struct(F.lit({"l": "left", "r": "right"}[x]).alias("side"), "implementation", "prim", "compiler", F.col(f"{x}_version").alias("version"), "olevel", F.col(f"{x}_path").alias("path"))
    return pairs.select(F.explode(F.array(side("l"), side("r"))).alias("x")).select("x.*")


def of_inlines(inlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, starts) of inlined instances (binary, caller, caller_ranges, inline, callee_ranges: arrays of structs lo, hi, of callees an array of those).

    A pair (binary, l_name, l_addr, r_name, r_addr) for each instance: the caller at
    its first range, and the first range of the first callee. starts (binary,
    addr): the callers, once each, that the binary is to be read for. An instance
    without a range of either gives neither.
    """
    first = inlines.select("binary", F.col("caller").alias("l_name"), F.get("caller_ranges", F.lit(0))["lo"].alias("l_addr"), F.col("inline").alias("r_name"), F.get(F.get("callee_ranges", F.lit(0)), F.lit(0))["lo"].alias("r_addr"))
    pairs = first.where("l_addr is not null and r_addr is not null")
    return pairs, pairs.select("binary", F.col("l_addr").alias("addr")).distinct()


def enriched(results: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """results with the columns of their rows in the plan. A result whose key isn't planned ends the job."""
    p = plan.withColumn("_planned", F.lit(True))
    out = results.join(p, key, "left")
    known = F.when(F.col("_planned"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not planned: "), F.col(key).cast("string"))))
    return out.withColumn(key, known).drop("_planned")


def aligned(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """name, side: whether the children of two nodes with this name stand on both sides, or on one."""
    a, b = (df.select(name).distinct().withColumn(c, F.lit(True)) for df, c in ((left, "_l"), (right, "_r")))
    side = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_l").isNotNull(), "left").otherwise("right")
    return a.join(b, name, "full").select(name, side.alias("side"))


def chunked(df: DataFrame, order: str, chunks: int) -> DataFrame:
    """df with chunk: rows dealt evenly to so many chunks by a hash of a column, so that equal values share one; -1 for rows where it is null."""
    return df.withColumn("chunk", F.when(F.col(order).isNull(), -1).otherwise(F.pmod(F.xxhash64(order), F.lit(chunks))).cast("int"))


def speedup(df: DataFrame, seconds: str, wall: str, *by: str) -> DataFrame:
    """by, n, total, wall, speedup: the seconds that comparisons took together, against the longest wall time of the group."""
    out = df.groupBy(*by).agg(F.count(seconds).alias("n"), F.round(F.sum(seconds), 6).alias("total"), F.max(wall).alias("wall"))
    return out.withColumn("speedup", F.round(F.try_divide(F.col("total"), F.col("wall")), 6))


def call_sites(sites: DataFrame) -> DataFrame:
    """Distinct calls (func, site, ...). Equal rows are one call; two that differ at one site end the job."""
    rows = sites.distinct()
    n = F.count("*").over(Window.partitionBy("func", "site"))
    checked = F.when(n == 1, F.col("site")).otherwise(F.raise_error(F.concat(F.lit("two calls at "), F.col("site").cast("string"))))
    return rows.withColumn("site", checked)
