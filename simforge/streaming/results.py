"""Results as a stream: the best of each cluster so far, while runs still write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import sort_key
from ..sources.sexp import parse_results


def result_stream(spark: SparkSession, root: str) -> DataFrame:
    """Result lines of files as they appear below a folder, each distinct line once."""
    lines = spark.readStream.schema("value string").option("recursiveFileLookup", True).format("text").load(root)
    return parse_results(lines.dropDuplicates(["value"]))


def best_so_far(results: DataFrame) -> DataFrame:
    """cluster and its best result so far; of equal ones the one with the smallest line."""
    known = results.where("fuzz is not null").withColumn("d", F.coalesce("d", "n")).withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    top = F.max_by(F.struct("line", "fuzz", "overlap", "n", "d"), F.struct(sort_key().alias("k"), F.translate("line", "", "").alias("l")))
    return known.groupBy("cluster").agg(top.alias("best")).select("cluster", "best.*")


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each kind by window of event time; rows later than the watermark allows are left out of a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")
