"""Every query against its SQL in DuckDB."""

import decimal
import math

import duckdb
import pytest

from simforge import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else round(float(x), 5)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, d=SF):
    got = plans.queries()[name](spark, d)
    data = rows(got.columns, got.collect())
    if name in plans.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
        want = con.sql(plans.oracle_sql()[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert data == rows(want.columns, want.fetchall())
    return data


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, name):
    compare(spark, name)
