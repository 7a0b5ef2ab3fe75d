"""Ranked lexical search over postings that Spark joins to the terms of items.

The index is a table of postings. Documents are dealt to parts as they are read;
within a part a term is one row, in its bucket by hash of the term, with the
part's documents that have it. The table is bucketed by part and sorted by term
bucket and term, so that the sums of a document's scores are one task's and only
the best of each task are shuffled. A search joins the terms of all items to the
postings, scores each match in integers, sums by item and document and ranks.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, documents, freed, partitions, shared_dir, small_batches, written

#: UTF-8 bytes to those of terms: ASCII digits, letters in lower case and all bytes of other characters; the rest parts terms.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BUCKETS = 64

POSTINGS = "part long, bucket int, term string, n_docs int, n_terms long, postings array<struct<doc_id:long,nth:int,n:int,tf:int>>"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1)))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def part_rows(part: int, doc_ids: list, sizes: list[int], n_terms: list[int], terms: list[bytes], tfs: list[int]) -> Iterator[pa.RecordBatch]:
    """The rows of a part, a term each, and first one without a term that counts the part's documents and terms."""
    encoded = pa.array(terms, pa.binary()).dictionary_encode()
    which = encoded.indices.to_numpy()
    order = np.argsort(which, kind="stable")
    counts = np.bincount(which, minlength=len(encoded.dictionary))
    # Rows of one doc_id are told apart by their number in the part.
    seen: Counter = Counter()
    nth = []
    for d in doc_ids:
        nth.append(seen[d])
        seen[d] += 1
    doc = np.repeat(np.arange(len(doc_ids)), sizes)[order]
    ids = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
    columns = [ids, pa.array(np.array(nth, np.int32)[doc]), pa.array(np.array(n_terms, np.int32)[doc]), pa.array(np.array(tfs, np.int32)[order])]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays(columns, ["doc_id", "nth", "n", "tf"]))
    k = len(counts)
    names = ["part", "term", "n_docs", "n_terms", "postings"]
    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([None], pa.string()), pa.array([len(doc_ids)], pa.int32()), pa.array([sum(n_terms)]), pa.array([[]], lists.type)], names)
    whole = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part), k), encoded.dictionary.cast(pa.string()), pa.array(counts, pa.int32()), pa.nulls(k, pa.int64()), lists], names)
    for at in range(0, k, 20_000):
        yield whole.slice(at, 20_000)


def postings(docs: DataFrame, least: int = 500_000) -> DataFrame:
    """The rows of the index. A part ends with the document that brings it to `least` postings, and a task holds one part and an Arrow batch."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = (task.partitionId() if task else 0) << 32
        held: tuple[list, ...] = ([], [], [], [], [])
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = text.translate(TERMS).split()
                if not words:
                    continue
                count = Counter(words)
                for column, x in zip(held, (doc, len(count), len(words))):
                    column.append(x)
                held[3].extend(count.keys())
                held[4].extend(count.values())
                if len(held[3]) >= least:
                    yield from part_rows(part, *held)
                    part, held = part + 1, ([], [], [], [], [])
        if held[0]:
            yield from part_rows(part, *held)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = texts.mapInArrow(freed(run), "part long, term string, n_docs int, n_terms long, postings array<struct<doc_id:long,nth:int,n:int,tf:int>>")
    return rows.withColumn("bucket", bucket_of(F.col("term")))


class Index:
    """Postings of all documents, in the shared folder until drop(). Null and empty texts, and such without a term, are in no part and not counted."""

    def __init__(self, docs: DataFrame):
        self.spark: SparkSession = docs.sparkSession
        name = f"postings-{uuid.uuid4().hex}"
        self.name, self.path = name.replace("-", "_"), f"{shared_dir(self.spark)}/{name}"
        try:
            postings(docs).write.format("parquet").option("compression", "zstd").option("path", self.path).bucketBy(partitions(self.spark), "part").sortBy("bucket", "term").saveAsTable(self.name)
            total = self.rows().where("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
        except Exception:
            self.drop()
            raise
        self.n_docs, self.n_terms = total[0] or 0, total[1] or 0

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)

    def weights(self, items: DataFrame, few: int = 200_000) -> DataFrame:
        """item_id, bucket, term, w of the terms of items that some document has and that weigh anything: a written table. Rows of one item_id are one item."""
        asked = items.select(F.col("item_id"), F.explode(terms_of(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("term")).distinct()
        asked = written(asked.withColumn("bucket", bucket_of(F.col("term"))), "search-terms")
        distinct = asked.select("bucket", "term").distinct()
        if asked.count() <= few:
            distinct = F.broadcast(distinct)
        df = self.rows().where("term is not null").select("bucket", "term", "n_docs").join(distinct, ["bucket", "term"]).groupBy("bucket", "term").agg(F.sum("n_docs").alias("df"))
        w = F.floor(1000 * F.log((2.0 * self.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
        out = written(asked.join(df, ["bucket", "term"]).select("item_id", "bucket", "term", w.alias("w")).where("w > 0"), "search-weights")
        delete(self.spark, asked.written_at)
        return out

    def scores(self, weights: DataFrame) -> DataFrame:
        """item_id, doc_id, score of every document with a term of an item. Nothing is shuffled: a part's rows are one task's."""
        by_term = weights.groupBy("bucket", "term").agg(F.collect_list(F.struct("item_id", "w")).alias("items"))
        found = self.rows().where("term is not null").select("part", "bucket", "term", "postings").join(F.broadcast(by_term), ["bucket", "term"])
        each = found.select("part", "items", F.inline("postings"))
        m = f"(50 + (50 * cast(n as bigint) * {self.n_docs}) div {max(self.n_terms, 1)})"
        each = each.select("part", "items", "doc_id", "nth", F.expr(f"(1000000000 * cast(tf as bigint)) div (1000 * cast(tf as bigint) + 20 * {m})").alias("hit"))
        matches = each.select("part", "doc_id", "nth", "hit", F.inline("items"))
        return matches.groupBy("part", "item_id", "doc_id", "nth").agg(F.sum(F.col("w") * F.col("hit")).alias("score")).where("score > 0")

    def search(self, items: DataFrame, top: int = 50, block: int = 200_000) -> DataFrame:
        """item_id, rank, doc_id, score of each item's best documents: a written table.

        Equal scores rank by ascending doc_id, a null one first. An item without
        terms, or whose terms no document has, has no rows. Terms of items are
        broadcast in blocks of `block` rows, some MB, however many items there are.
        """
        weights = self.weights(items, block)
        blocks = -(-weights.count() // block) or 1
        best = None
        for b in range(blocks):
            some = weights if blocks == 1 else weights.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
            ranks = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
            ranked = self.scores(some).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top)
            best = ranked if best is None else best.unionByName(ranked)
        out = written(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "search")
        delete(self.spark, weights.written_at)
        return out


def op13_ranked_search(spark, sf_dir):
    index = Index(documents(spark, sf_dir))
    try:
        return index.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    finally:
        index.drop()


OP13_SQL = r"""
WITH words AS (
  SELECT d, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)
), postings AS (
  SELECT d, doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM words GROUP BY ALL
), sizes AS (
  SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY d
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, d, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (d), totals GROUP BY item_id, d
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 50
"""
