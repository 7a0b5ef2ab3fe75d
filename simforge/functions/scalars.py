"""Scalar functions on columns: bits, names, time-outs, strided intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_bits(v: Column) -> Column:
    """Number of bits of a mask of low ones; null for anything else, 0 included."""
    return F.when((v != 0) & (v.bitwiseAND(v + 1) == 0), F.bit_count(v))


def first_set(v: Column) -> Column:
    """Place of the lowest set bit, null for 0."""
    return F.when(v != 0, F.bit_count(v.bitwiseAND(-v) - 1))


def trailing_ones(v: Column) -> Column:
    return F.bit_count(F.shiftrightunsigned(v.bitwiseXOR(v + 1), 1))


def gcd(a: Column, b: Column, rounds: int = 92) -> Column:
    """By Euclid; two 64-bit numbers need 92 divisions at most."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)["a"]


def timeout_seconds(spec: Column) -> Column:
    """10, 10s, 10m or 10h as seconds; null for anything else."""
    ok = spec.rlike(r"^[1-9][0-9]*[smh]?$")
    unit = F.regexp_extract(spec, r"([smh]?)$", 1)
    return F.when(ok, F.regexp_extract(spec, r"^([0-9]+)", 1).cast("long") * F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1))


def commutative(op: Column) -> Column:
    return op.isin("+", "*", "&", "|", "^", "=", "!=")


def is_call_or_return(asm: Column) -> Column:
    return asm.rlike(r"(^|\n)\s*(call|ret)\b")


def small_range(lo: Column, hi: Column) -> Column:
    """Whether all values lie within 24 bits of 0, which no pointer does."""
    return (F.abs(lo) < 1 << 24) & (F.abs(hi) < 1 << 24)


def is_subset(a: Column, b: Column) -> Column:
    """Whether every item of array a is in array b."""
    return F.size(F.array_except(a, b)) == 0


def take(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def drop(items: Column, n: int) -> Column:
    return F.slice(items, n + 1, F.greatest(F.size(items) - n, F.lit(0)))


def padded(items: Column, n: int, value: Column) -> Column:
    """items, followed by so many values that there are n at least."""
    return F.concat(items, F.array_repeat(value, F.greatest(F.lit(n) - F.size(items), F.lit(0))))


def arrangements(items: Column, n: int) -> Column:
    """All ordered choices of n different items of a short array of distinct ones; of all of them, its permutations."""
    out = F.transform(items, lambda x: F.array(x))
    for _ in range(n - 1):
        out = F.flatten(F.transform(out, lambda p: F.transform(F.array_except(items, p), lambda x: F.concat(p, F.array(x)))))
    return out


def is_position_call(asm: Column) -> Column:
    """A call of the next instruction, which only takes its address."""
    return asm.rlike(r"(^|\n)\s*call\s+(\$\+5|0x0*5\b|\.\+5)")


def merged_maps(a: Column, b: Column, combine) -> Column:
    """Both maps; where both have a key, combine(value, value)."""
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(combine(x, y)))


def filtered_map(m: Column, keep) -> Column:
    """The entries for which keep(key, value) holds."""
    return F.map_filter(m, keep)


def random_bits(key: Column, bits: int, seed: int = 0) -> Column:
    """A number of so many bits for each key, the same in every run of a seed."""
    return F.xxhash64(F.lit(seed), key).bitwiseAND((1 << bits) - 1)


def listed(items: Column, opening: str = "[", separator: str = "; ", closing: str = "]") -> Column:
    """The items of an array as text."""
    return F.concat(F.lit(opening), F.array_join(F.transform(items, lambda x: x.cast("string")), separator), F.lit(closing))


def bit_text(v: Column, width: int) -> Column:
    """The lowest bits of a number, highest first."""
    return F.lpad(F.right(F.bin(v), F.lit(width)), width, "0")
