import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from simforge.llm import divergence as d
from simforge.llm.common import documents

from helpers import ODD, SF

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=10, top=10):
    """rows (text, lang, source) by the definition, in Python's whole numbers."""
    rows = [(t or "", a or "", s or "") for t, a, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, n, sources = Counter(), Counter(), defaultdict(set)
    for t, a, s in rows:
        words = TERM.findall(t.translate(lower))
        sources[a].add(s)
        df.update((a, w) for w in set(words))
        n.update((a, s, w) for w in words)
    out = set()
    for a, names in sources.items():
        kept = [w for (b, w), k in df.items() if b == a and k >= min_docs]
        v = len(kept)
        count = {s: [n[a, s, w] for w in kept] for s in names}
        count[None] = [sum(c) for c in zip(*count.values())]
        p = {s: [1 + 10**9 * (x + 2) // (sum(c) + 2 * v) for x in c] for s, c in count.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in names:
            pairs = sorted((-sum(map(f, p[s], p[o])), o.encode()) for o in names if o != s)
            terms = sorted((-f(x, q), w.encode()) for w, c, x, q in zip(kept, count[s], p[s], p[None]) if c and x > q)
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out |= {(a, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ROWS = [
    *[(f"Apple pear {'fig ' * (i % 4)}", "en", f"s{i % 3}") for i in range(12)],
    *[("apple Ünd Äpfel \x00 naïve-naïve 漢字", "de", s) for s in ("x", "y", "y", None)],
    *[(t, None, "z") for _, t in ODD],
    *[("fig", "en", "s1")] * 3,
    ("", "en", "empty"),
    ("only one", "fr", "s0"),
]


def test_brute(spark):
    for least in (1, 3, 10):
        assert got(d.divergence(frame(spark, ROWS), min_docs=least, top=2)) == brute(ROWS, least, 2)


def test_ties_rank_by_item(spark):
    rows = [("b a ab", "en", s) for s in ("q", "p", "Q", "é")] + [("b a ab ab a b", "en", "r")]
    assert got(d.divergence(frame(spark, rows), min_docs=1)) == brute(rows, 1)


def test_terms_are_spread_where_sources_are_many(spark):
    df = frame(spark, ROWS)
    terms = d.kept_terms(df, 1)
    langs = d.languages(df, terms)
    wide = d.vectors(terms, langs, few=0)
    assert sorted(map(str, wide.collect())) == sorted(map(str, d.vectors(terms, langs).collect()))


def test_counts_are_flushed(spark):
    df = frame(spark, ROWS)
    sums = lambda held: {tuple(r) for r in d.term_counts(d.plain(df), held).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("df")).collect()}
    assert sums(0) == sums(10**6)


def test_shares_beyond_64_bits(spark):
    n, below = 9 * 10**18 - 2, 9 * 10**18 + 7
    df = spark.createDataFrame([(n, below)], "n long, below long")
    assert df.select(d.share(F.col("n"), F.col("below"))).first()[0] == 1 + 10**9 * (n + 2) // below


def test_empty_table(spark):
    assert d.divergence(frame(spark, [])).collect() == []


def test_clashing_columns(spark):
    df = frame(spark, ROWS)
    for c in ("term", "n", "df", "counts", "p", "q", "_salt"):
        df = df.withColumn(c, F.lit("x"))
    assert got(d.divergence(df, min_docs=3)) == brute(ROWS, 3)


def test_query(spark):
    rows = [(r.text, r.lang, r.source) for r in documents(spark, SF).collect()]
    want = brute(rows)
    assert got(d.op12_source_divergence(spark, SF)) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert set(con.sql(d.OP12_SQL).fetchall()) == want
