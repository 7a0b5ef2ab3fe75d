"""Views of the driver's tables as programs, graphs, subjects and results, in Spark and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")


def statements(spark, sf_dir) -> DataFrame:
    """func, pos, avar, op, a, b: an order is a function, its lines are statements in order."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    t = table(spark, sf_dir, "lineitem")
    op = F.when(F.col("l_returnflag") == "A", "load").when(F.col("l_returnflag") == "N", "add").otherwise("store")
    return t.select(F.col("l_orderkey").alias("func"), F.row_number().over(w).cast("long").alias("pos"), (F.col("l_suppkey") % 8).alias("avar"), op.alias("op"), (F.col("l_partkey") % 8).alias("a"), F.col("l_quantity").cast("long").alias("b"))


STMT = f"""stmt AS (SELECT l_orderkey AS func, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS pos, l_suppkey % 8 AS avar,
  CASE l_returnflag WHEN 'A' THEN 'load' WHEN 'N' THEN 'add' ELSE 'store' END AS op, l_partkey % 8 AS a, CAST(l_quantity AS BIGINT) AS b FROM lineitem)"""


def transitions(spark, sf_dir, daily: bool = True) -> DataFrame:
    """graph, src, dst, label (nullable): an event and the next one of its user, on the same day if daily."""
    e = table(spark, sf_dir, "events")
    graph = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")) if daily else F.col("user_id").cast("string")
    e = e.select(graph.alias("graph"), "ts", "event_id", "event_type", "value")
    w = Window.partitionBy("graph").orderBy("ts", "event_id")
    label = F.when(F.col("value") >= 75, True).when(F.col("value") >= 50, False)
    return e.select("graph", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), label.alias("label")).where("dst is not null")


def edges(spark, sf_dir, daily: bool = True) -> DataFrame:
    return transitions(spark, sf_dir, daily).distinct()


def edge_sql(daily: bool = True) -> str:
    g = "CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d')" if daily else "CAST(user_id AS VARCHAR)"
    return f"""moves AS (SELECT graph, src, dst, label FROM (SELECT {g} AS graph, event_type AS src, lead(event_type) OVER (PARTITION BY {g} ORDER BY ts, event_id) AS dst,
  CASE WHEN value >= 75 THEN true WHEN value >= 50 THEN false END AS label FROM events) WHERE dst IS NOT NULL), edge AS (SELECT DISTINCT * FROM moves)"""


def subjects(spark, sf_dir) -> DataFrame:
    """id, compiler, major, version, prim, olevel, symbol, addr: parts as compiled functions."""
    p = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1)
    return p.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "gcc").otherwise("clang").alias("compiler"), F.concat_ws(".", brand, (F.col("p_size") % 4).cast("string")).alias("major"),
        F.concat_ws(".", brand, (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 3).cast("string")).alias("version"), F.lower("p_type").alias("prim"), F.concat(F.lit("O"), (F.col("p_size") % 4).cast("string")).alias("olevel"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("symbol"), (F.col("p_partkey") * 16 + 4096).alias("addr"),
    )


SUBJECT = r"""subject AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'gcc' ELSE 'clang' END AS compiler,
  regexp_extract(p_brand, '(\d+)', 1) || '.' || (p_size % 4) AS major, regexp_extract(p_brand, '(\d+)', 1) || '.' || (p_size % 4) || '.' || (p_partkey % 3) AS version,
  lower(p_type) AS prim, 'O' || (p_size % 4) AS olevel, replace(p_name, ' ', '_') AS symbol, p_partkey * 16 + 4096 AS addr FROM part)"""


def results(spark, sf_dir) -> DataFrame:
    """A comparison for each order: block matches by kind, sizes of both sides, flags and groups. One in eleven failed, and has no counts."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus", "l_quantity")
    is_a, is_n = F.col("l_returnflag") == "A", F.col("l_returnflag") == "N"
    part = is_a & (F.col("l_quantity") > 45)
    sub, sup = is_n & (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 35), is_n & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 35)
    agg = li.groupBy("o_orderkey").agg(F.count("*").alias("n_total"), F.count_if(part).alias("n_partial"), F.count_if(sub).alias("n_sub"), F.count_if(sup).alias("n_sup"))
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ok = k % 11 != 0
    got = lambda c: F.when(ok, c)
    return o.join(agg, "o_orderkey").select(
        k.alias("id"), F.col("o_orderpriority").alias("grp"), (F.col("o_custkey") % 10).alias("symbol"), *[got(F.col(c)).alias(c) for c in ("n_total", "n_partial", "n_sub", "n_sup")], F.col("n_total").alias("s1"), (1 + F.col("o_custkey") % 8).alias("s2"),
        got(F.least(F.col("n_total"), 1 + F.col("o_custkey") % 8, 1 + k % 7)).alias("n"), (k % 5 == 0).alias("identical"), ((F.col("o_orderstatus") != "P") & ok).alias("completed"), (F.col("o_custkey") % 3 == 0).alias("iso_v"), ((F.col("o_custkey") % 3 == 0) | (F.col("o_custkey") % 4 == 0)).alias("iso_f"), (k % 2).alias("run"), (k - k % 2).alias("cluster"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day"),
    )


RESULT = """kinds AS (SELECT l_orderkey AS o_orderkey, count(*) AS n_total, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 45) AS n_partial,
  count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity > 35) AS n_sub, count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'F' AND l_quantity > 35) AS n_sup FROM lineitem GROUP BY 1),
raw AS (SELECT o_orderkey AS id, o_orderpriority AS grp, o_custkey % 10 AS symbol, CASE WHEN ok THEN n_total END AS n_total, CASE WHEN ok THEN n_partial END AS n_partial, CASE WHEN ok THEN n_sub END AS n_sub, CASE WHEN ok THEN n_sup END AS n_sup,
  n_total AS s1, 1 + o_custkey % 8 AS s2, CASE WHEN ok THEN least(n_total, 1 + o_custkey % 8, 1 + o_orderkey % 7) END AS n,
  o_orderkey % 5 = 0 AS identical, o_orderstatus <> 'P' AND ok AS completed, o_custkey % 3 = 0 AS iso_v, o_custkey % 3 = 0 OR o_custkey % 4 = 0 AS iso_f, o_orderkey % 2 AS run, o_orderkey - o_orderkey % 2 AS cluster, o_custkey AS cust, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day
  FROM (SELECT *, o_orderkey % 11 <> 0 AS ok FROM orders JOIN kinds USING (o_orderkey))),
result AS (SELECT *, CASE WHEN n_total IS NULL THEN NULL WHEN n_partial > 0 OR (n_sub > 0 AND n_sup > 0) THEN 'Fuzzy' WHEN n_sub > 0 THEN 'SubsetAndExact' WHEN n_sup > 0 THEN 'SupersetAndExact' ELSE 'ExactOnly' END AS fuzz,
  round((n_total - 0.5 * (n_partial + n_sub + n_sup)) / n_total, 6) AS mean,
  CASE WHEN n IS NULL THEN NULL WHEN n = s1 AND n = s2 THEN 'Total' WHEN n = s2 AND n > 0 THEN 'Superset' WHEN n = s1 AND n > 0 THEN 'Subset' ELSE 'Partial' END AS overlap, CASE WHEN n IS NULL THEN NULL WHEN s1 > s2 THEN s1 ELSE s2 END AS d FROM raw)"""


def intervals(spark, sf_dir) -> DataFrame:
    """base, lo, hi, width: accesses by part."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_partkey").alias("base"), (F.col("l_quantity") * 4).cast("long").alias("lo"), (F.col("l_quantity") * 4 + F.col("l_linenumber") % 4 * 4).cast("long").alias("hi"), (F.col("l_linenumber") % 4 * 4 + 1).cast("long").alias("width"))


INTERVAL = """access AS (SELECT l_partkey AS base, CAST(l_quantity * 4 AS BIGINT) AS lo, CAST(l_quantity * 4 + l_linenumber % 4 * 4 AS BIGINT) AS hi, CAST(l_linenumber % 4 * 4 + 1 AS BIGINT) AS width FROM lineitem)"""
