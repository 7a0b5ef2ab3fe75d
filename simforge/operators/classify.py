"""The classification of matches, its order, and reports over classified results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_class(direct: Column, left: Column, right: Column) -> Column:
    """Kind of a block match from direct matches and what is unmatched on either side. The order of the cases matters."""
    return (
        F.when((left == 0) & (right == 0), "Exact").when(right == 0, "Superset").when(left == 0, "Subset").when(direct == 0, "Fail").otherwise("Partial")
    )


def fuzziness(n_partial: Column, n_sub: Column, n_sup: Column) -> Column:
    return F.when((n_partial > 0) | ((n_sub > 0) & (n_sup > 0)), "Fuzzy").when(n_sub > 0, "SubsetAndExact").when(n_sup > 0, "SupersetAndExact").otherwise("ExactOnly")


def overlap(n: Column, s1: Column, s2: Column) -> Column:
    return F.when((n == s1) & (n == s2), "Total").when((n == s2) & (n > 0), "Superset").when((n == s1) & (n > 0), "Subset").otherwise("Partial")


def good_enough(kind: Column, n: Column, s1: Column, s2: Column) -> Column:
    return (kind != "Partial") | ((n > F.floor(s1 / 2)) & (n > F.floor(s2 / 2)))


def classified(df: DataFrame) -> DataFrame:
    """df (n_total, n_partial, n_sub, n_sup, n, s1, s2) with fuzz, mean, overlap and d, the larger side. A failed comparison has null counts, and null in all of these."""
    mean = (F.col("n_total") - 0.5 * (F.col("n_partial") + F.col("n_sub") + F.col("n_sup"))) / F.col("n_total")
    some = F.col("n_total").isNotNull()
    return df.withColumns({"fuzz": F.when(some, fuzziness(F.col("n_partial"), F.col("n_sub"), F.col("n_sup"))), "mean": F.round(mean, 6), "overlap": F.when(some, overlap(F.col("n"), F.col("s1"), F.col("s2"))), "d": F.when(some, F.greatest("s1", "s2"))})


def sort_key() -> Column:
    """Orders results as the lattice does: failed ones (null fuzz) below all; exact above sub- and superset above fuzzy; within, by overlap, then matches; fuzzy ones by their mean and then their counts alone."""
    fuzzy = F.coalesce(F.col("fuzz") == "Fuzzy", F.lit(False))
    some = F.col("fuzz").isNotNull()
    rank = F.when(~some | fuzzy, 0).when(F.col("fuzz") == "ExactOnly", 2).otherwise(1)
    kind = F.when(~some | fuzzy, 0).when(F.col("overlap") == "Total", 2).when(F.col("overlap") == "Partial", 0).otherwise(1)
    share = F.when(F.col("overlap") == "Partial", F.col("n") / F.col("d")).otherwise(F.col("n").cast("double"))
    counts = [F.when(fuzzy, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("n_total", "n_partial", "n_sub", "n_sup")]
    return F.struct(some.alias("some"), rank.alias("rank"), F.when(fuzzy, F.col("mean")).otherwise(0.0).alias("mean"), *counts, kind.alias("kind"), F.when(~some | fuzzy, 0.0).otherwise(F.round(share, 9)).alias("share"))


def score() -> Column:
    """What ranks results of one pair: the fuzziness, and the overlap, matched blocks by the hundred."""
    fuzz = F.when(F.col("fuzz") == "ExactOnly", 4.0).when(F.col("fuzz") == "Fuzzy", F.col("mean")).otherwise(2.0)
    return fuzz + F.when(F.col("overlap") == "Partial", F.col("n") / F.col("d")).otherwise(100.0 * F.col("n"))


def best(df: DataFrame, key: str, tie: str) -> DataFrame:
    """The best result of each key; of equal ones the one with the smallest tie."""
    if dict(df.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint"):
        # The smallest number is the largest of the negated; null comes before all.
        order = F.struct(sort_key(), F.col(tie).isNull(), -F.col(tie).cast("decimal(20,0)"))
        return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct("*"), order).alias("_x")).select("_x.*")
    w = Window.partitionBy(key).orderBy(sort_key().desc(), F.col(tie))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in a given order."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("_x")).select("_x.*")


def is_exact() -> Column:
    return (F.col("fuzz") == "ExactOnly") & (F.col("overlap") == "Total")


def percent(n: Column, d: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(100.0 * n, d), F.lit(0.0)), 6)


def funnel(df: DataFrame, *by: str) -> DataFrame:
    """total, identical, completed, isomorphic before and after, exact: each counted in the population of the stage before it."""
    done = F.col("completed") & ~F.col("identical")
    steps = {"n_identical": F.col("identical"), "n_completed": done, "n_iso_v": done & F.col("iso_v"), "n_iso_f": done & F.col("iso_f"), "n_exact": done & F.col("iso_f") & is_exact()}
    out = df.groupBy(*by).agg(F.count("*").alias("n_all"), *[F.count_if(c).alias(k) for k, c in steps.items()])
    before = {"n_identical": F.col("n_all"), "n_completed": F.col("n_all") - F.col("n_identical"), "n_iso_v": F.col("n_completed"), "n_iso_f": F.col("n_completed"), "n_exact": F.col("n_iso_f")}
    return out.withColumns({k.replace("n_", "pct_"): percent(F.col(k), b) for k, b in before.items()})


def summary(df: DataFrame, *by: str) -> DataFrame:
    """Counts of exact, incomplete by how many blocks miss, the rest, and failed comparisons."""
    inc, miss = (F.col("fuzz") == "ExactOnly") & (F.col("overlap") != "Total"), F.col("d") - F.col("n")
    part = inc & (F.col("overlap") == "Partial")
    fail = ~F.col("completed")
    ok = ~fail
    return df.groupBy(*by).agg(
        F.count("*").alias("n_all"), F.count_if(ok & is_exact()).alias("n_exact"), F.count_if(ok & inc).alias("n_incomplete"), F.count_if(ok & part & (miss == 1)).alias("n_missing_1"), F.count_if(ok & part & (miss == 2)).alias("n_missing_2"), F.count_if(ok & ~is_exact() & ~inc).alias("n_rest"), F.count_if(fail).alias("n_fail"),
    )


def subsets(df: DataFrame) -> DataFrame:
    """df once for each report subset that a row belongs to."""
    tags = F.array_compact(F.array(F.lit("ALL"), F.when(F.col("completed"), "WITHOUT-FAILED"), F.when(F.col("iso_f"), "ISOMORPHIC"), F.when(F.col("identical"), "SELF")))
    return df.withColumn("subset", F.explode(tags))


def compare_runs(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, status: better, worse or same from the old run to the new one, new or gone where one of them lacks the key."""
    a = old.select(F.col(key), sort_key().alias("_a"))
    b = new.select(F.col(key), sort_key().alias("_b"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") < F.col("_b"), "better").when(F.col("_a") > F.col("_b"), "worse").otherwise("same")
    return a.join(b, key, "full").select(key, status.alias("status"))


def confusion(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    out = df.select(actual.alias("a"), predicted.alias("p")).agg(F.count("*").alias("total"), F.count_if("a").alias("sites"), F.count_if(F.col("a") & F.col("p")).alias("tp"), F.count_if(~F.col("a") & F.col("p")).alias("fp"))
    out = out.withColumn("fn", F.col("sites") - F.col("tp")).withColumn("tn", F.col("total") - F.col("fp") - F.col("tp") - F.col("fn"))
    return out.withColumns({"tp_pct": percent(F.col("tp"), F.col("sites")), "fn_pct": percent(F.col("fn"), F.col("sites"))})


def histogram(df: DataFrame, value: str, side: Column) -> DataFrame:
    """bin, n_left, n_right over the whole range of values, zeros filled in."""
    n = df.groupBy(F.col(value).alias("bin")).agg(F.count_if(side).alias("n_left"), F.count_if(~side).alias("n_right"))
    bins = n.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("bin"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def moments(df: DataFrame, by: str, value: str, label: str) -> DataFrame:
    """Count, mean, deviation, and the extremes with what they belong to."""
    v = F.col(value)
    key = F.struct(v.alias("v"), F.col(label).alias("l"))
    return df.groupBy(by).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.min(key)["l"].alias("at_min"), F.max(key)["l"].alias("at_max"))


def partitioned(df: DataFrame, classifier: Column, item: str) -> DataFrame:
    """class, items: the sorted items of each class. A class's items are one row, as the report lists them; null classes are one class."""
    return df.groupBy(classifier.alias("class")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def checked_total(groups: DataFrame, df: DataFrame) -> DataFrame:
    """groups with n_input, the number of rows of df. If the groups' n_all don't add up to it, the job ends."""
    n = df.agg(F.count("*").alias("n_input")).join(groups.agg(F.coalesce(F.sum("n_all"), F.lit(0)).alias("_sum")))
    checked = n.select(F.when(F.col("n_input") == F.col("_sum"), F.col("n_input")).otherwise(F.raise_error(F.lit("the groups don't add up to the input"))).alias("n_input"))
    return groups.crossJoin(F.broadcast(checked))  # one row


def function_ranges(ranges: DataFrame) -> DataFrame:
    """start, end, names (sorted, distinct) of functions (start, end, name); two ends of one start end the job."""
    g = ranges.groupBy("start").agg(F.min("end").alias("_lo"), F.max("end").alias("_hi"), F.array_sort(F.collect_set("name")).alias("names"))
    end = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.raise_error(F.concat(F.lit("two ends of the function at "), F.col("start").cast("string"))))
    return g.select("start", end.alias("end"), "names")


def without_subsumed(df: DataFrame, every: DataFrame, by: list[str], specific: Column) -> DataFrame:
    """df without the specific rows of keys that have a catch-all (every: by)."""
    marked = df.join(every.select(*by).distinct().withColumn("_every", F.lit(True)), by, "left")
    return marked.where(F.col("_every").isNull() | ~specific).drop("_every")
