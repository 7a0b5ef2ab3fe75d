"""Line dedup over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by line hash, of the keys that a batch
brought first: how many of its documents hold each, and the largest of their ids.
A new batch is sorted and merged against the runs, in an anti-join: keys that no
run has are its own and make a run; what it counts of keys that some run has goes
to a smaller table of updates. So no two runs have a key in common, and a key's
row is the batch's that met it first. When a level has as many runs as the
fanout, they are compacted to one run of the next level. As all runs lie in the
same buckets, sorted, these merges shuffle and sort nothing but the batch, and
each row is rewritten a logarithmic number of times. The answer is read from the
owners' rows, with the updates of each.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, discard, documents, partitions, row_key, setting, shared_dir, texts, written

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def line_hash(line: Column, min_chars: int) -> Column:
    """128 bits of the key; null for keys under min_chars code points."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.substring(F.unhex(F.sha2(key, 256)), 1, 16))


class Run:
    """One sorted table: h, n_docs, max_doc, in buckets by h and sorted in each."""

    def __init__(self, rows: DataFrame, buckets: int):
        self.spark = rows.sparkSession
        name = f"line-run-{uuid.uuid4().hex}"
        self.name, self.path = name.replace("-", "_"), f"{shared_dir(self.spark)}/{name}"
        with setting(self.spark, ORDERED, "true"):
            rows.write.format("parquet").option("compression", "zstd").option("path", self.path).bucketBy(buckets, "h").sortBy("h").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


#: Scans of tables with one file to a bucket are known to be sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """The levelled runs, oldest first in each level, and the updates of their rows. No batch may bring a document that an earlier one had."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels, self.buckets = spark, fanout, [[]], partitions(spark)
        self.updates: list[Run] = []

    def _runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        """Takes the lines (h, doc_id) of a batch: its keys are held against all runs in one merge, and those that none has are its own."""
        keys = lines.groupBy("h").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        batch = own = Run(keys, self.buckets)
        if runs := self._runs():
            with setting(self.spark, ORDERED, "true"):
                new = batch.rows()
                for run in runs:
                    new = new.join(run.rows().select("h").hint("merge"), "h", "left_anti")
                own = Run(new, self.buckets)
                self.updates.append(Run(batch.rows().join(own.rows().select("h").hint("merge"), "h", "left_anti"), self.buckets))
            batch.drop()
        self.levels[0].append(own)
        self._compact()

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                return
            if i + 1 == len(self.levels):
                self.levels.append([])
            with setting(self.spark, ORDERED, "true"):
                self.levels[i + 1].append(Run(self._merged(level), self.buckets))
            self.levels[i] = []
            for run in level:
                run.drop()

    @staticmethod
    def _merged(runs: list[Run]) -> DataFrame:
        """The rows of all runs, no two of which have a key in common."""
        out = runs[0].rows()
        for run in runs[1:]:
            other = run.rows().select("h", *[F.col(c).alias(f"{c}_2") for c in ("n_docs", "max_doc")])
            out = out.join(other.hint("merge"), "h", "full").select("h", *[F.coalesce(c, f"{c}_2").alias(c) for c in ("n_docs", "max_doc")])
        return out

    def totals(self) -> DataFrame | None:
        """h, n_docs, max_doc over all runs, the row of each key's owner with its updates; None before the first batch."""
        if not (runs := self._runs()):
            return None
        out = self._merged(runs)
        if self.updates:
            more = functools.reduce(DataFrame.unionByName, [u.rows() for u in self.updates])
            more = more.groupBy("h").agg(F.sum("n_docs").alias("_n"), F.max("max_doc").alias("_max"))
            out = out.join(more, "h", "left").select("h", (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "_max").alias("max_doc"))
        return out

    def frequent(self, min_docs: int) -> DataFrame:
        """h, max_doc of the keys that min_docs documents hold: a written table."""
        with setting(self.spark, ORDERED, "true"):
            return written(self.totals().where(F.col("n_docs") >= min_docs).select("h", "max_doc"), "line-frequent")

    def drop(self) -> None:
        for run in [*self._runs(), *self.updates]:
            run.drop()
        self.levels, self.updates = [[]], []


def frequent_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 2) -> tuple[DataFrame, DataFrame]:
    """(lines, frequent), both written: hashed lines _rk, pos, h, doc_id of all documents, and the keys that min_docs hold after all batches."""
    spark = docs.sparkSession
    t = texts(docs).withColumn("_rk", row_key())
    lines = t.select("_rk", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("_rk", "doc_id", "pos", line_hash(F.col("line"), min_chars).alias("h")).where("h is not null")
    # Documents go to batches by id, so that the counts of batches add up.
    lines = written(lines.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "lines")
    runs = LineRuns(spark, fanout)
    try:
        for b in range(batches):
            runs.add(lines.where(F.col("batch") == b).select("h", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id")))
        return lines, runs.frequent(min_docs)
    finally:
        runs.drop()


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Each row of docs, all columns, with _lines (before), _dropped (sorted distinct positions) and _kept (the text that stays).

    A key of min_chars code points or more that min_docs documents hold stays in
    the largest doc_id only. A null or empty text is one empty line. Rows of one
    doc_id count as one document, and all of them keep their lines if that id is
    the largest; a null doc_id is one document, smaller than all others. Repeated
    rows get equal results. A line on very many documents is pre-aggregated
    before its shuffle, and joined back as a skewed key.
    """
    lines, frequent = frequent_lines(docs, min_docs, min_chars, batches, fanout)
    dropped = lines.join(frequent, "h").where(F.coalesce("doc_id", F.lit(-(2**63))) < F.col("max_doc")).groupBy("_rk").agg(F.sort_array(F.collect_set("pos")).alias("_dropped"))
    dropped = written(dropped, "line-dropped")
    discard(lines, frequent)
    rows = docs.select(F.struct("*").alias("_row")).select("_row", F.col("_row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("_row.text").cast("string"), F.lit("")).alias("text"))
    out = rows.withColumn("_rk", row_key()).join(dropped, "_rk", "left")
    split = F.split("text", "\n", -1)
    gone = F.coalesce("_dropped", F.array().cast("array<int>"))
    kept = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("_dropped"), i)), "\n"))
    return out.select("_row", F.size(split).alias("_lines"), gone.alias("_dropped"), kept.alias("_kept"))


def op5_line_dedup(spark, sf_dir):
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_lines").cast("long").alias("n_lines"), F.size("_dropped").cast("long").alias("n_dropped"), F.sha2(F.col("_kept"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, f.k IS NOT NULL AND doc_id < f.last AS gone FROM keyed LEFT JOIN frequent f USING (k)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the lines gone from text, the length column n_chars following, all other columns as they are. Documents left without any text stay."""
    out = line_dedup(docs, **options)
    has = "n_chars" in docs.columns
    columns = [F.when(F.size("_dropped") > 0, F.col("_kept")).otherwise(F.col("_row.text")).alias("text") if c == "text" else F.when(F.size("_dropped") > 0, F.length("_kept").cast(dict(docs.dtypes)[c])).otherwise(F.col("_row.n_chars")).alias(c) if c == "n_chars" and has else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)
