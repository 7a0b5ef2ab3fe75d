import math
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from simforge.llm import search as s

from helpers import ODD, SF, frame, sample

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items, top=50):
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, length = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, n in docs:
            m = 50 + 50 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is not None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, top=50, **options):
    index = s.Index(docs)
    try:
        return sorted([tuple(r) for r in index.search(spark.createDataFrame(items, "item_id long, text string"), top, **options).select("item_id", "rank", "doc_id", "score").collect()], key=repr)
    finally:
        index.drop()


ITEMS = [(1, "Same ROW no id"), (2, None), (3, "nowhere else"), (4, "word x a B ü 漢字 same same"), (5, "a"), (5, "no"), (6, "- \n"), (7, "one x" + "x" * 69999)]


def test_brute(spark):
    assert searched(spark, frame(spark, ODD, extra=True), ITEMS) == brute(ODD, ITEMS)


def test_blocks_of_items(spark):
    rows = sample(spark, 80)
    items = [(i, t[:200]) for i, t in rows[:9]]
    assert searched(spark, frame(spark, rows), items, top=5, block=40) == brute(rows, items, 5)


def test_ties_and_repeated_rows(spark):
    r = random.Random(5)
    rows = [(r.randrange(40), " ".join(r.choice("abcdefgh") for _ in range(6))) for _ in range(200)] + [(3, "a b c")] * 4
    items = [(i, " ".join(r.choice("abcdefghz") for _ in range(3))) for i in range(12)]
    assert searched(spark, frame(spark, rows), items, 7) == brute(rows, items, 7)


def test_parts(spark):
    """A document's sums don't depend on how documents are dealt to parts, and are one task's."""
    rows = sample(spark, 60)
    docs = frame(spark, rows)
    few, many = (s.postings(docs, least) for least in (100, 10**6))
    parts = lambda df: df.select("part").distinct().count()
    assert parts(few) > parts(many)
    flat = lambda df: sorted(tuple(r) for r in df.where("term is not null").select("term", F.inline("postings")).drop("nth").collect())
    assert flat(few) == flat(many)
    index = s.Index(docs)
    weights = index.weights(spark.createDataFrame(ITEMS, "item_id long, text string"))
    plan = index.scores(weights)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning(part" not in plan
    index.drop()


def test_empty_tables(spark):
    assert searched(spark, frame(spark, []), ITEMS) == []
    assert searched(spark, frame(spark, ODD), []) == []
    assert searched(spark, frame(spark, [(1, None), (2, " .")]), ITEMS) == []


def test_nothing_stays_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    s.op13_ranked_search(spark, SF)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute(rows, items)
    assert sorted([tuple(r) for r in s.op13_ranked_search(spark, SF).collect()], key=repr) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(con.sql(s.OP13_SQL).fetchall(), key=repr) == want
