"""Source divergence audit over wide term vectors.

For each language, the terms that enough of its documents have are kept. A kept
term is one row: a vector with its count in each source of the language, in the
order of sources. Higher-order functions smooth the counts to shares of a billion
and emit what the term adds to the divergence of each pair of sources, which the
aggregation sums before it shuffles anything.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, documents, freed, partitions, small_batches, written

#: UTF-8 bytes to those of terms: ASCII letters in lower case and all bytes of other characters; the rest parts terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SHARE = 1_000_000_000


def term_counts(docs: DataFrame, held: int = 300_000) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents), added up for some documents at a time. A task holds `held` terms, and one batch's more."""
    small_batches(docs.sparkSession)
    names = ["lang", "source", "term", "n", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in counts.items():
                terms = list(n)
                for at in range(0, len(terms), 20_000):
                    some = terms[at : at + 20_000]
                    keys = [pa.repeat(pa.scalar(x, pa.string()), len(some)) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(some, pa.binary()).cast(pa.string()), *[pa.array([c[t] for t in some], pa.int64()) for c in (n, df)]], names)
            counts.clear()

        for b in batches:
            for lang, source, text in zip(*[b.column(i).to_pylist() for i in range(3)]):
                n, df = counts.get((lang, source)) or counts.setdefault((lang, source), (Counter(), Counter()))
                words = text.translate(LETTERS).split()
                n.update(words)
                df.update(set(words))
            if sum(len(n) for n, _ in counts.values()) > held:
                yield from rows()
        yield from rows()

    return docs.mapInArrow(freed(run), "lang string, source string, term string, n long, df long")


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def kept_terms(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """lang, term, counts (map of source to occurrences) of the terms in at least min_docs documents of the language: a written table.

    Counts are dealt by language and term once, and summed over tasks and then put together there.
    """
    dealt = term_counts(plain(docs)).repartition(partitions(docs.sparkSession), "lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = summed.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return written(terms.where(F.col("df") >= min_docs).drop("df"), "divergence-terms")


def languages(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each language: its sources in order, each one's least denominator N + 2 V, the language's own, and V: a written table. Its size is that of the list of sources, the square of which is the result's."""
    groups = plain(docs).select("lang", "source").distinct()
    totals = terms.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    each = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    v = terms.groupBy("lang").agg(F.count("*").alias("v"))
    rows = each.join(v, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    below = F.transform("g.n", lambda n: n + 2 * F.col("v"))
    return written(rows.select("lang", "v", F.col("g.source").alias("sources"), below.alias("below"), (F.aggregate("g.n", F.lit(0).cast("long"), lambda a, n: a + n) + 2 * F.col("v")).alias("all_below")), "divergence-languages")


def share(count: Column, below: Column) -> Column:
    """1 + floor(SHARE * (count + 2) / below), exact: the product is a decimal, as it may leave 64 bits."""
    return F.lit(1).cast("long") + F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(SHARE).cast("decimal(10,0)"), below.cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), which 64 bits hold for shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def vectors(terms: DataFrame, langs: DataFrame, few: int = 50_000) -> DataFrame:
    """lang, term, c (count in each source), p (share in each), q (share in the language).

    Where languages have no more than `few` sources together, a few MB, they are
    broadcast; otherwise terms are salted, as one language may have most of them.
    """
    spark = terms.sparkSession
    if (langs.agg(F.sum(F.size("sources"))).first()[0] or 0) <= few:
        both = terms.join(F.broadcast(langs), "lang")
    else:
        n = partitions(spark)
        salted = langs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        both = terms.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")).join(salted, ["lang", "_salt"])
    c = F.transform("sources", lambda s: F.coalesce(F.try_element_at("counts", s), F.lit(0).cast("long")))
    both = both.select("lang", "term", "below", "all_below", c.alias("c"))
    return both.select("lang", "term", "c", F.zip_with("c", "below", share).alias("p"), share(F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x), F.col("all_below")).alias("q"))


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group of docs.

    Part `pair` has each other source of the language, and how far the two are
    apart over all kept terms; part `term` the `top` kept terms that are most above
    their share in the language. Null lang, source and text are ''. A language
    without kept terms has pairs of value 0. Repeated rows count each for itself.
    A source with a third of all documents is counted in the tasks that read it,
    and a language with most terms is spread over all tasks by term.
    """
    terms = kept_terms(docs, min_docs)
    langs = languages(docs, terms)
    vector = vectors(terms, langs)
    # A term's pairs are emitted source by source, so that a row holds one vector however many sources there are.
    first = vector.select("lang", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("i"))
    later = first.select("lang", "i", F.posexplode(F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda q: apart(F.get("p", F.col("i")), q))).alias("k", "f"))
    sums = later.groupBy("lang", "i", (F.col("i") + 1 + F.col("k")).alias("j")).agg(F.sum("f").alias("f"))
    named = langs.select("lang", "sources", F.posexplode("sources").alias("a", "source"))
    pairs = named.select("lang", "source", "a", F.posexplode("sources").alias("b", "item")).where("a != b").withColumn("i", F.least("a", "b")).withColumn("j", F.greatest("a", "b"))
    pairs = pairs.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0).cast("long")).alias("value"))
    above = F.transform("p", lambda p, i: F.struct(i.alias("a"), F.when((F.get("c", i) > 0) & (p > F.col("q")), apart(p, F.col("q"))).alias("value")))
    marked = vector.select("lang", "term", F.inline(F.filter(above, lambda x: x["value"].isNotNull())))
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "term")
    best = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    best = best.join(named.select("lang", "a", "source"), ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
    out = written(out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")), "divergence")
    for table in (terms, langs):
        delete(docs.sparkSession, table.written_at)
    return out


def op12_source_divergence(spark, sf_dir):
    return divergence(documents(spark, sf_dir))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), per_doc AS (
  SELECT d, lang, source, term, count(*) AS n FROM words GROUP BY ALL
), kept AS (
  SELECT lang, term FROM per_doc GROUP BY ALL HAVING count(*) >= 10
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY ALL
), sources AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, sum(n) AS n FROM per_doc SEMI JOIN kept USING (lang, term) GROUP BY ALL
), vectors AS (
  SELECT s.lang, s.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM sources s JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM vectors JOIN sizes USING (lang)
), whole AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q FROM vectors JOIN sizes USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((
    SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM shares x JOIN shares y ON x.term = y.term AND x.lang = y.lang WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source
  ), 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
