"""Islands, bounds and containment of accesses of which many are equal, against plain definitions."""

import random

import duckdb
import pytest

from simforge import plans
from simforge.operators import intervals as I
from simforge.plans import encode as E

SF = "/root/testdata/sf0.1"

# The islands of the registered SQL with equal accesses counted first, so that ORDER BY lo, hi leaves no ties.
UNTIED = f"""{E.INTERVAL}, once AS (SELECT base, lo, hi, count(*) AS k FROM access GROUP BY ALL),
marked AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY base ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM once),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY base ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM marked),
isl AS (SELECT base, min(lo) AS lo, max(hi) AS hi, CAST(sum(k) AS BIGINT) AS n FROM numbered GROUP BY base, i)"""


def accesses(seed):
    """(base, lo, hi, width), each several times and shuffled, so that an order by lo and hi leaves ties."""
    r = random.Random(seed)
    distinct = [(base, lo, lo + w - 1, w) for base in range(8) for lo, w in ((r.randrange(0, 120, 4), r.choice((1, 5, 9, 13))) for _ in range(12))]
    rows = [row for row in distinct for _ in range(r.randint(2, 5))]
    r.shuffle(rows)
    return rows


def plain_islands(rows):
    """(base, lo, hi, n): runs of points that are covered, linked where one access covers both a point and the next."""
    found = []
    for base in {row[0] for row in rows}:
        own = [(lo, hi) for b, lo, hi, _ in rows if b == base]
        points = {p for lo, hi in own for p in range(lo, hi + 1)}
        links = {p for lo, hi in own for p in range(lo, hi)}
        for start in (p for p in points if p - 1 not in links):
            end = start
            while end in links:
                end += 1
            found.append((base, start, end, sum(start <= lo <= end for lo, _ in own)))
    return sorted(found)


@pytest.fixture(params=range(3))
def tied(spark, request):
    rows = accesses(request.param)
    return rows, spark.createDataFrame(rows, "base long, lo long, hi long, width long").repartition(6)


def test_islands_of_equal_rows(tied):
    rows, df = tied
    assert sorted(map(tuple, I.islands(df, ["base"]).select("base", "lo", "hi", "n").collect())) == plain_islands(rows)


def test_bounds_of_equal_rows(tied):
    rows, df = tied
    widths = {b: ",".join(map(str, sorted({w for base, _, _, w in rows if base == b}))) for b, *_ in rows}
    want = [(*i, widths[i[0]]) for i in plain_islands(rows)]
    assert sorted(map(tuple, I.bounds(df, "base", "width").select("base", "lo", "hi", "n", "widths").collect())) == want


def test_containment_of_equal_rows(tied):
    rows, df = tied
    want = sorted((b, lo, hi, i[1], i[2], False) for b, lo, hi, _ in rows for i in plain_islands(rows) if i[0] == b and i[1] <= lo <= i[2])
    assert len(want) == len(rows)
    inner = df.select("base", "lo", "hi")
    got = I.contained(inner, I.islands(inner, ["base"]), "base")
    assert sorted(map(tuple, got.select("base", "lo", "hi", "outer_lo", "outer_hi", "overhangs").collect())) == want


@pytest.fixture(scope="module")
def lines():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    return con


def queried(spark, name, columns):
    return sorted(map(tuple, plans.queries()[name](spark, SF).select(*columns).collect()))


def test_islands_query(spark, lines):
    want = sorted(lines.sql(f"WITH {UNTIED} SELECT base, lo, hi, n FROM isl").fetchall())
    assert queried(spark, "n3_w11_islands", ("base", "lo", "hi", "n")) == want


def test_bounds_query(spark, lines):
    want = sorted(lines.sql(f"WITH {UNTIED} SELECT base, lo, hi, n, widths FROM isl JOIN (SELECT base, string_agg(CAST(width AS VARCHAR), ',' ORDER BY width) AS widths FROM (SELECT DISTINCT base, width FROM access) GROUP BY base) USING (base)").fetchall())
    assert queried(spark, "a27_bounds", ("base", "lo", "hi", "n", "widths")) == want


def test_containment_query(spark, lines):
    want = lines.sql(f"WITH {UNTIED} SELECT count(*), count(*) FILTER (WHERE a.hi > i.hi), CAST(sum(i.lo) AS BIGINT) FROM access a JOIN isl i ON a.base = i.base AND a.lo >= i.lo AND a.lo <= i.hi").fetchall()
    assert lines.sql("SELECT count(*) FROM lineitem").fetchall() == [(want[0][0],)]
    assert queried(spark, "j13_containment", ("n", "n_over", "sum_lo")) == want
