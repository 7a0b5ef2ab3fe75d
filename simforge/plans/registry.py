"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classify as C
from ..operators import graphs as G
from ..operators import intervals as I
from ..operators import pairs as P
from ..operators import straightline as L
from . import encode as E

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def res(s, d):
    return C.classified(E.results(s, d))


def longs(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


EXACT = "fuzz = 'ExactOnly' AND overlap = 'Total'"
DONE = "completed AND NOT identical"
RANK = "CASE WHEN fuzz IS NULL OR fuzz = 'Fuzzy' THEN 0 WHEN fuzz = 'ExactOnly' THEN 2 ELSE 1 END"
COUNTS = ", ".join(f"{c} := CASE WHEN fuzz = 'Fuzzy' THEN {c} ELSE 0 END" for c in ("n_total", "n_partial", "n_sub", "n_sup"))
KEY = f"""struct_pack("known" := fuzz IS NOT NULL, rank := {RANK}, mean := CASE WHEN fuzz = 'Fuzzy' THEN mean ELSE 0.0 END, {COUNTS}, kind := CASE WHEN fuzz IS NULL OR fuzz = 'Fuzzy' THEN 0 WHEN overlap = 'Total' THEN 2 WHEN overlap = 'Partial' THEN 0 ELSE 1 END,
  share := CASE WHEN fuzz IS NULL OR fuzz = 'Fuzzy' THEN 0.0 WHEN overlap = 'Partial' THEN round(n / d, 9) ELSE CAST(n AS DOUBLE) END)"""


def pct(n: str, d: str) -> str:
    return f"round(CASE WHEN {d} = 0 THEN 0.0 ELSE 100.0 * {n} / {d} END, 6)"


FUNNEL = f"""SELECT {{by}} n_all, n_identical, n_completed, n_iso_v, n_iso_f, n_exact, {pct("n_identical", "n_all")} AS pct_identical, {pct("n_completed", "(n_all - n_identical)")} AS pct_completed,
  {pct("n_iso_v", "n_completed")} AS pct_iso_v, {pct("n_iso_f", "n_completed")} AS pct_iso_f, {pct("n_exact", "n_iso_f")} AS pct_exact FROM (
  SELECT {{by}} count(*) AS n_all, count(*) FILTER (WHERE identical) AS n_identical, count(*) FILTER (WHERE {DONE}) AS n_completed, count(*) FILTER (WHERE {DONE} AND iso_v) AS n_iso_v,
  count(*) FILTER (WHERE {DONE} AND iso_f) AS n_iso_f, count(*) FILTER (WHERE {DONE} AND iso_f AND {EXACT}) AS n_exact FROM result {{group}})"""
SUMMARY = f"""count(*) AS n_all, count(*) FILTER (WHERE completed AND {EXACT}) AS n_exact, count(*) FILTER (WHERE completed AND fuzz = 'ExactOnly' AND overlap <> 'Total') AS n_incomplete,
  count(*) FILTER (WHERE completed AND fuzz = 'ExactOnly' AND overlap = 'Partial' AND d - n = 1) AS n_missing_1, count(*) FILTER (WHERE completed AND fuzz = 'ExactOnly' AND overlap = 'Partial' AND d - n = 2) AS n_missing_2,
  count(*) FILTER (WHERE completed AND fuzz <> 'ExactOnly') AS n_rest, count(*) FILTER (WHERE NOT completed) AS n_fail"""


# Reports


@query("a3_funnel", f"WITH {E.RESULT} " + FUNNEL.format(by="", group=""))
def _(s, d):
    return C.funnel(res(s, d))


@query("a4_funnel_by_group", f"WITH {E.RESULT} " + FUNNEL.format(by="grp,", group="GROUP BY grp"))
def _(s, d):
    return C.funnel(res(s, d), "grp")


@query("a5_a6_coverage", f"""WITH {E.RESULT}, m AS (SELECT cust, bool_or(identical) AS trivial, bool_or(completed AND NOT identical AND {EXACT}) AS advanced FROM result GROUP BY cust)
SELECT count(*) AS n_subjects, count(*) FILTER (WHERE trivial OR advanced) AS n_matched, count(*) FILTER (WHERE trivial AND NOT advanced) AS n_trivial_only, count(*) FILTER (WHERE advanced AND NOT trivial) AS n_advanced_only FROM m""")
def _(s, d):
    m = res(s, d).groupBy("cust").agg(F.bool_or("identical").alias("t"), F.bool_or(F.col("completed") & ~F.col("identical") & C.is_exact()).alias("a"))
    t, a = F.col("t"), F.col("a")
    return m.agg(F.count("*").alias("n_subjects"), F.count_if(t | a).alias("n_matched"), F.count_if(t & ~a).alias("n_trivial_only"), F.count_if(a & ~t).alias("n_advanced_only"))


@query("a7_summary", f"WITH {E.RESULT} SELECT {SUMMARY} FROM result")
def _(s, d):
    return C.summary(res(s, d))


@query("a8_summary_by_symbol", f"WITH {E.RESULT} SELECT symbol, {SUMMARY} FROM result GROUP BY symbol")
def _(s, d):
    return C.summary(res(s, d), "symbol")


@query("a9_a10_summary_by_adjacent", f"""WITH {E.RESULT}, v AS (SELECT grp AS l, lead(grp) OVER (ORDER BY grp) AS r FROM (SELECT DISTINCT grp FROM result))
SELECT l, r, symbol, {SUMMARY} FROM result JOIN v ON grp = l WHERE r IS NOT NULL GROUP BY l, r, symbol""")
def _(s, d):
    r = res(s, d)
    v = r.select("grp").distinct().groupBy().agg(F.array_sort(F.collect_set("grp")).alias("g")).select(F.explode(F.zip_with("g", F.slice("g", F.lit(2), F.size("g")), lambda a, b: F.struct(a.alias("l"), b.alias("r")))).alias("x")).select("x.*").where("r is not null")
    return C.summary(r.join(v, F.col("grp") == F.col("l")), "l", "r", "symbol")


@query("a11_summary_by_subset", f"""WITH {E.RESULT}, t AS (SELECT *, 'ALL' AS subset FROM result UNION ALL SELECT *, 'WITHOUT-FAILED' FROM result WHERE completed UNION ALL SELECT *, 'ISOMORPHIC' FROM result WHERE iso_f UNION ALL SELECT *, 'SELF' FROM result WHERE identical)
SELECT subset, {SUMMARY} FROM t GROUP BY subset""")
def _(s, d):
    return C.summary(C.subsets(res(s, d)), "subset")


@query("a1_best_result", f"WITH {E.RESULT} SELECT cust, id, fuzz, overlap, n, d FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY {KEY} DESC, id) AS r FROM result) WHERE r = 1")
def _(s, d):
    return C.best(res(s, d), "cust", "id").select("cust", "id", "fuzz", "overlap", "n", "d")


@query("a2_last_result", f"WITH {E.RESULT} SELECT cust, id, fuzz, overlap FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY id DESC) AS r FROM result) WHERE r = 1")
def _(s, d):
    return C.last(res(s, d), "cust", "id").select("cust", "id", "fuzz", "overlap")


@query("j7_a13_compare_runs", f"""WITH {E.RESULT}, best AS (SELECT * FROM (SELECT cust, status, {KEY} AS k, row_number() OVER (PARTITION BY cust, status ORDER BY {KEY} DESC, id) AS r FROM result) WHERE r = 1),
a AS (SELECT cust, k FROM best WHERE status = 'F'), b AS (SELECT cust, k FROM best WHERE status = 'O')
SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN a.k < b.k THEN 'better' WHEN a.k > b.k THEN 'worse' ELSE 'same' END AS status FROM a FULL JOIN b USING (cust)) GROUP BY status""")
def _(s, d):
    r = res(s, d)
    old, new = (C.best(r.where(F.col("status") == x), "cust", "id") for x in "FO")
    return C.compare_runs(old, new, "cust").groupBy("status").agg(F.count("*").alias("n"))


@query("a12_confusion", f"""SELECT *, {pct("tp", "sites")} AS tp_pct, {pct("fn", "sites")} AS fn_pct FROM (SELECT *, sites - tp AS fn, total - fp - sites AS tn FROM (
  SELECT count(*) AS total, count(*) FILTER (WHERE a) AS sites, count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND p) AS fp FROM (
  SELECT quality = 0 AS a, n_chars > 3000 AS p FROM labels JOIN documents USING (doc_id))))""")
def _(s, d):
    t = E.table(s, d, "labels").join(E.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return C.confusion(t, F.col("quality") == 0, F.col("n_chars") > 3000)


@query("a14_matches_by_kind", f"""WITH {E.RESULT} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN s1 = n AND s2 = n THEN 'Exact' WHEN s2 = n THEN 'Superset' WHEN s1 = n THEN 'Subset' WHEN n = 1 THEN 'Fail' ELSE 'Partial' END AS kind FROM result WHERE n IS NOT NULL) GROUP BY kind""")
def _(s, d):
    k = C.block_class(F.col("n") - 1, F.col("s1") - F.col("n"), F.col("s2") - F.col("n"))
    return res(s, d).where("n is not null").select(k.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("a15_a16_a17_classes", f"WITH {E.RESULT} SELECT fuzz, overlap, count(*) AS n, round(avg(mean), 6) AS mean FROM result GROUP BY fuzz, overlap")
def _(s, d):
    return res(s, d).groupBy("fuzz", "overlap").agg(F.count("*").alias("n"), F.round(F.avg("mean"), 6).alias("mean"))


@query("o1_ranked", f"WITH {E.RESULT}, x AS (SELECT cust, id, round(CASE fuzz WHEN 'ExactOnly' THEN 4.0 WHEN 'Fuzzy' THEN mean ELSE 2.0 END + CASE WHEN overlap = 'Partial' THEN n / d ELSE 100.0 * n END, 6) AS score FROM result) SELECT cust, id, score, rank() OVER (PARTITION BY cust ORDER BY score DESC, id) AS place FROM x")
def _(s, d):
    x = res(s, d).select("cust", "id", F.round(C.score(), 6).alias("score"))
    return x.withColumn("place", F.rank().over(Window.partitionBy("cust").orderBy(F.desc("score"), "id")).cast("long"))


@query("r4_good_enough", f"WITH {E.RESULT} SELECT good, count(*) AS n FROM (SELECT overlap <> 'Partial' OR (n > s1 // 2 AND n > s2 // 2) AS good FROM result) GROUP BY good")
def _(s, d):
    return res(s, d).select(C.good_enough(F.col("overlap"), F.col("n"), F.col("s1"), F.col("s2")).alias("good")).groupBy("good").agg(F.count("*").alias("n"))


@query("a21_moments", """SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS sd, arg_min(o_orderkey, struct_pack(v := o_totalprice, l := o_orderkey)) AS at_min, arg_max(o_orderkey, struct_pack(v := o_totalprice, l := o_orderkey)) AS at_max FROM orders GROUP BY 1""")
def _(s, d):
    return C.moments(E.table(s, d, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey")


@query("a22_profile_tree", """SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def _(s, d):
    t = E.table(s, d, "customer").join(F.broadcast(E.table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(E.table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("a25_histogram", """WITH h AS (SELECT p_size AS bin, count(*) FILTER (WHERE p_retailprice < 1000) AS n_left, count(*) FILTER (WHERE p_retailprice >= 1000) AS n_right FROM part GROUP BY 1)
SELECT CAST(bin AS BIGINT) AS bin, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM (SELECT unnest(generate_series((SELECT min(bin) FROM h), (SELECT max(bin) FROM h))) AS bin) LEFT JOIN h USING (bin)""")
def _(s, d):
    return longs(C.histogram(E.table(s, d, "part"), "p_size", F.col("p_retailprice") < 1000), "bin", "n_left", "n_right")


@query("a19_ranges", "SELECT c_nationkey AS start, count(*) AS n, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS names FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY 1")
def _(s, d):
    t = E.table(s, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    return t.groupBy(F.col("c_nationkey").alias("start")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("c_mktsegment")), ",").alias("names"))


@query("a30_common_prefix", f"""WITH {E.STMT}, x AS (SELECT func % 50 AS g, func, pos, op FROM stmt), n AS (SELECT g, count(DISTINCT func) AS k FROM x GROUP BY g),
p AS (SELECT g, pos, count(*) AS k, count(DISTINCT op) AS d FROM x GROUP BY g, pos), bad AS (SELECT p.g, min(pos) AS pos FROM p JOIN n ON p.g = n.g WHERE p.k <> n.k OR d > 1 GROUP BY p.g)
SELECT n.g, coalesce((SELECT pos - 1 FROM bad WHERE bad.g = n.g), (SELECT max(pos) FROM p WHERE p.g = n.g)) AS length FROM n""")
def _(s, d):
    ops = E.statements(s, d).groupBy("func").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "op"))), lambda x: x["op"]).alias("ops"))
    return longs(L.common_prefix(ops.withColumn("g", F.col("func") % 50), "g", "ops"), "length")


# Joins and pairs


@query("j1_cluster_join", f"WITH {E.RESULT} SELECT count(b.id) AS n_joined, count(*) - count(b.id) AS n_left_only FROM (SELECT * FROM result WHERE run = 0) a LEFT JOIN (SELECT * FROM result WHERE run = 1) b USING (cluster)")
def _(s, d):
    r = E.results(s, d)
    a, b = r.where("run = 0").select("cluster"), r.where("run = 1").select("cluster", "id")
    return a.join(b, "cluster", "left").agg(F.count("id").alias("n_joined"), (F.count("*") - F.count("id")).alias("n_left_only"))


@query("j3_bucket_exists", "SELECT DISTINCT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal)")
def _(s, d):
    top = E.table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("top"))
    return E.table(s, d, "customer").join(top, "c_nationkey").where("top > c_acctbal").select("c_custkey").distinct()


@query("j4_unordered_pairs", f"WITH {E.SUBJECT} SELECT a.prim, a.symbol, a.id AS l, b.id AS r FROM subject a JOIN subject b ON a.prim = b.prim AND a.symbol = b.symbol AND a.version = b.version AND a.id < b.id")
def _(s, d):
    return P.unordered(E.subjects(s, d), ["prim", "symbol", "version"], "id").select("prim", "symbol", "l", "r")


@query("j5_adjacent_pairs", f"WITH {E.SUBJECT} SELECT compiler, prim, id AS l, r FROM (SELECT *, lead(id) OVER (PARTITION BY compiler, prim ORDER BY version, id) AS r FROM subject) WHERE r IS NOT NULL")
def _(s, d):
    return P.adjacent(E.subjects(s, d), ["compiler", "prim"], ["version", "id"], "id")


@query("j6_disjoint_pairs", "WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, min(o_orderkey) AS l, max(o_orderkey) AS r FROM x WHERE n % 2 = 0 GROUP BY o_custkey, (k - 1) // 2")
def _(s, d):
    o = E.table(s, d, "orders").select("o_custkey", "o_orderkey")
    even = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n % 2 = 0")
    return P.disjoint(o.join(even, "o_custkey"), ["o_custkey"], ["o_orderkey"], "o_orderkey")


@query("j8_without_results", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def _(s, d):
    return E.table(s, d, "customer").join(E.table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j10_lookups", """SELECT c_custkey, coalesce(n, 0) AS n, coalesce(s, 0) AS n_suppliers FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""")
def _(s, d):
    n = E.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    k = E.table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("k"))
    return E.table(s, d, "customer").join(n, "c_custkey", "left").join(k, "c_nationkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("n_suppliers"))


@query("j11_range_join", """WITH r AS (SELECT p_partkey % 40 AS u, p_partkey AS range_id, p_partkey * 100 AS s, p_partkey * 100 + p_size * 10 AS e FROM part) SELECT range_id, count(*) AS n, min(event_id) AS first_event FROM (SELECT event_id, CAST(value * 1000 AS BIGINT) AS v FROM events) JOIN r ON v >= s AND v < e GROUP BY 1""")
def _(s, d):
    r = E.table(s, d, "part").select(F.col("p_partkey").alias("range_id"), (F.col("p_partkey") * 100).alias("s"), (F.col("p_partkey") * 100 + F.col("p_size") * 10).alias("e"))
    p = E.table(s, d, "events").select("event_id", F.round(F.col("value") * 1000).cast("long").alias("v"))
    return I.in_range(p, r, "v", "s", "e", 1000).groupBy("range_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("j12_as_of", """SELECT event_id, (SELECT max_by(event_id, ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'click' AND b.ts <= a.ts) AS click FROM events a WHERE event_type = 'purchase'""")
def _(s, d):
    e = E.table(s, d, "events").select("user_id", "event_id", "event_type", "ts")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("click"))
    return I.as_of(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), clicks, "user_id", "ts", "start", "click").select("event_id", "click")


ISLANDS = """isl AS (SELECT base, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY base ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM (
  SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY base ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM access)) GROUP BY base, i)"""


@query("n3_w11_islands", f"WITH {E.INTERVAL}, {ISLANDS} SELECT * FROM isl")
def _(s, d):
    return I.islands(E.intervals(s, d), ["base"])


@query("a27_bounds", f"WITH {E.INTERVAL}, {ISLANDS} SELECT isl.*, w.widths FROM isl JOIN (SELECT base, string_agg(CAST(width AS VARCHAR), ',' ORDER BY width) AS widths FROM (SELECT DISTINCT base, width FROM access) GROUP BY base) w USING (base)")
def _(s, d):
    return I.bounds(E.intervals(s, d), "base", "width")


@query("j13_containment", f"WITH {E.INTERVAL}, {ISLANDS} SELECT count(*) AS n, count(*) FILTER (WHERE a.hi > i.hi) AS n_over, CAST(sum(i.lo) AS BIGINT) AS sum_lo FROM access a JOIN isl i ON a.base = i.base AND a.lo >= i.lo AND a.lo <= i.hi")
def _(s, d):
    a = E.intervals(s, d).select("base", "lo", "hi")
    c = I.contained(a, I.islands(a, ["base"]), "base")
    return c.agg(F.count("*").alias("n"), F.count_if("overhangs").alias("n_over"), F.sum("outer_lo").alias("sum_lo"))


@query("n1_intersect", f"WITH {E.INTERVAL} SELECT base, lo, hi, CASE WHEN greatest(lo, 50) <= least(hi, 90) THEN greatest(lo, 50) END AS both_lo, CASE WHEN greatest(lo, 50) <= least(hi, 90) THEN least(hi, 90) END AS both_hi FROM access")
def _(s, d):
    lo, hi = I.intersect(F.col("lo"), F.col("hi"), F.lit(50).cast("long"), F.lit(90).cast("long"))
    return E.intervals(s, d).select("base", "lo", "hi", lo.alias("both_lo"), hi.alias("both_hi"))


@query("n5_high_bound", f"WITH {E.INTERVAL} SELECT base, lo, width, CASE WHEN lo + 9223372036854775000 > 9223372036854775807 - (width - 1) THEN 9223372036854775807 ELSE lo + 9223372036854775000 + width - 1 END AS hi FROM access")
def _(s, d):
    return E.intervals(s, d).select("base", "lo", "width", I.high_bound(F.col("lo") + 9223372036854775000, F.col("width")).alias("hi"))


@query("b1_batches", f"""WITH {E.SUBJECT}, v AS (SELECT DISTINCT compiler, major, version FROM subject), p AS (SELECT a.compiler, a.major, a.version AS lv, b.version AS rv FROM v a JOIN v b ON a.compiler = b.compiler AND a.major = b.major AND a.version < b.version)
SELECT l.prim, l.olevel, l.compiler, lv, rv, l.symbol, l.id AS l_id, r.id AS r_id FROM p JOIN subject l ON l.compiler = p.compiler AND l.version = lv JOIN subject r ON r.compiler = p.compiler AND r.version = rv AND r.prim = l.prim AND r.symbol = l.symbol AND r.olevel = l.olevel""")
def _(s, d):
    x = E.subjects(s, d)
    v = P.unordered(x.select("compiler", "major", "version").distinct(), ["compiler", "major"], "version").withColumnsRenamed({"l": "lv", "r": "rv"}).select("compiler", "lv", "rv")
    left = x.select("compiler", F.col("version").alias("lv"), "prim", "olevel", "symbol", F.col("id").alias("l_id"))
    right = x.select("compiler", F.col("version").alias("rv"), "prim", "olevel", "symbol", F.col("id").alias("r_id"))
    return left.join(v, ["compiler", "lv"]).join(right, ["compiler", "rv", "prim", "olevel", "symbol"]).select("prim", "olevel", "compiler", "lv", "rv", "symbol", "l_id", "r_id")


@query("b8_tags", f"WITH {E.SUBJECT}, p AS (SELECT id AS l, lead(id) OVER (PARTITION BY compiler, prim ORDER BY version, id) AS r FROM subject), t AS (SELECT l AS item, l || '--' || r AS tag FROM p WHERE r IS NOT NULL UNION ALL SELECT r, l || '--' || r FROM p WHERE r IS NOT NULL) SELECT item, tag FROM t")
def _(s, d):
    return P.tagged(P.adjacent(E.subjects(s, d), ["compiler", "prim"], ["version", "id"], "id"))


@query("p1_p8_subject_names", f"WITH {E.SUBJECT} SELECT id, prim || '-' || compiler || '-' || version || '-' || olevel || '-' || symbol || '-0x' || lower(to_hex(addr)) AS name, prim, version, addr, major FROM subject")
def _(s, d):
    named = E.subjects(s, d).select("id", P.subject_name().alias("name"))
    p = P.parse_subject(F.col("name"))
    return named.select("id", "name", p["prim"].alias("prim"), p["version"].alias("version"), p["addr"].alias("addr"), F.substring_index(p["version"], ".", 2).alias("major"))


@query("p7_cluster_keys", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS l, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS r FROM part")
def _(s, d):
    t = E.table(s, d, "part")
    k = F.concat_ws("--", "p_name", "p_brand", F.when(F.col("p_partkey") % 3 == 0, "more"))
    c = P.parse_cluster(k)
    return t.select("p_partkey", c[0].alias("l"), c[1].alias("r"))


@query("p11_normal_identifiers", r"""WITH x AS (SELECT doc_id, text, regexp_extract_all(text, '[a-z]*(?:ing|ly)\b') AS m, regexp_split_to_array(text, '[a-z]*(?:ing|ly)\b') AS parts FROM documents),
f AS (SELECT *, list_filter(m, lambda v, i: list_position(m, v) = i) AS ids FROM x)
SELECT doc_id, array_to_string(list_transform(parts, lambda p, i: p || CASE WHEN i <= len(m) THEN '_' || list_position(ids, m[i]) ELSE '' END), '') AS normal FROM f""")
def _(s, d):
    return E.table(s, d, "documents").select("doc_id", P.normal_identifiers(F.col("text"), "[a-z]*(?:ing|ly)\\b").alias("normal"))


@query("f1_versions", f"WITH {E.SUBJECT} SELECT id, version FROM subject WHERE compiler = 'gcc' AND regexp_matches(version, '^(?:1\\d?\\.[01])')")
def _(s, d):
    return P.matching_versions(E.subjects(s, d), "gcc", r"1\d?\.[01]").select("id", "version")


@query("f9_calls", "SELECT doc_id, regexp_matches(text, '(^|\\n)\\s*(call|ret)\\b') AS is_call FROM documents")
def _(s, d):
    return E.table(s, d, "documents").select("doc_id", S.is_call_or_return(F.col("text")).alias("is_call"))


# Scalars


@query("f13_n8_n9_bits", """SELECT v, CASE WHEN v <> 0 AND v & (v + 1) = 0 THEN CAST(bit_count(v) AS BIGINT) END AS mask_bits, CASE WHEN v <> 0 THEN CAST(bit_count((v & -v) - 1) AS BIGINT) END AS first_set, CAST(bit_count(xor(v, v + 1) >> 1) AS BIGINT) AS trailing_ones FROM (SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS v FROM orders)""")
def _(s, d):
    t = E.table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("v")).distinct()
    return longs(t.select("v", S.mask_bits(F.col("v")).alias("mask_bits"), S.first_set(F.col("v")).alias("first_set"), S.trailing_ones(F.col("v")).alias("trailing_ones")), "mask_bits", "first_set", "trailing_ones")


@query("n6_gcd", "SELECT l_partkey, l_suppkey, gcd(l_partkey, l_suppkey) AS g FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def _(s, d):
    return E.table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct().select("l_partkey", "l_suppkey", S.gcd(F.col("l_partkey"), F.col("l_suppkey")).alias("g"))


@query("p_timeouts", "SELECT p_partkey, p_size * CASE p_partkey % 4 WHEN 2 THEN 60 WHEN 3 THEN 3600 ELSE 1 END AS seconds FROM part")
def _(s, d):
    t = E.table(s, d, "part")
    unit = F.element_at(F.array(F.lit(""), F.lit("s"), F.lit("m"), F.lit("h")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.select("p_partkey", S.timeout_seconds(F.concat(F.col("p_size").cast("string"), unit)).cast("int").alias("seconds"))


@query("n14_commutative", f"WITH {E.STMT} SELECT op, op = 'add' AS commutative, count(*) AS n FROM stmt GROUP BY op")
def _(s, d):
    return E.statements(s, d).groupBy("op").agg(F.count("*").alias("n")).select("op", S.commutative(F.when(F.col("op") == "add", "+").otherwise("-")).alias("commutative"), "n")


# Statements


@query("w3_load_ordinals", f"WITH {E.STMT} SELECT func, pos, ordinal FROM (SELECT *, CAST(sum(CASE WHEN op = 'load' THEN 1 ELSE 0 END) OVER (PARTITION BY func ORDER BY pos) - 1 AS BIGINT) AS ordinal FROM stmt) WHERE op = 'load'")
def _(s, d):
    return longs(L.load_ordinals(E.statements(s, d)).select("func", "pos", "ordinal"), "ordinal")


@query("w4_stack_height", f"WITH {E.STMT} SELECT func, pos, CASE WHEN max(CASE WHEN a = 7 THEN 1 ELSE 0 END) OVER w = 0 THEN CAST(sum(CASE WHEN op = 'add' THEN b ELSE -b END) OVER w AS BIGINT) END AS height FROM stmt WINDOW w AS (PARTITION BY func ORDER BY pos)")
def _(s, d):
    return longs(L.running_height(E.statements(s, d), F.when(F.col("op") == "add", F.col("b")).otherwise(-F.col("b")), F.col("a") == 7).select("func", "pos", "height"), "height")


DEFS = "uses AS (SELECT u.func, u.pos, u.a AS var, max(d.pos) AS from_pos FROM stmt u LEFT JOIN stmt d ON d.func = u.func AND d.avar = u.a AND d.pos < u.pos GROUP BY ALL)"


@query("w5_j17_last_definitions", f"WITH {E.STMT}, {DEFS} SELECT * FROM uses")
def _(s, d):
    return L.last_definitions(E.statements(s, d))


@query("w6_remaining", f"WITH {E.STMT} SELECT func, pos, count(*) FILTER (WHERE op = 'load') OVER (PARTITION BY func ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS loads_left FROM stmt")
def _(s, d):
    return L.remaining(E.statements(s, d)).select("func", "pos", "loads_left")


@query("w7_killed", f"WITH {E.STMT} SELECT func, pos, by_pos FROM (SELECT *, lead(pos) OVER (PARTITION BY func, avar ORDER BY pos) AS by_pos FROM stmt) WHERE by_pos IS NOT NULL")
def _(s, d):
    return L.killed(E.statements(s, d)).select("func", "pos", "by_pos")


@query("w8_carried", f"WITH {E.STMT} SELECT func, var FROM (SELECT func, a AS var, min(pos) AS u FROM stmt GROUP BY ALL) JOIN (SELECT func, avar AS var, min(pos) AS d FROM stmt GROUP BY ALL) USING (func, var) WHERE u <= d")
def _(s, d):
    return L.carried(E.statements(s, d))


@query("w9_live_at_end", f"WITH {E.STMT} SELECT func, avar, max(pos) AS pos FROM stmt GROUP BY func, avar")
def _(s, d):
    return L.live_at_end(E.statements(s, d)).select("func", "avar", "pos")


@query("w10_pieces", f"WITH {E.STMT} SELECT func, pos, CAST(coalesce(sum(CASE WHEN op = 'store' THEN 1 ELSE 0 END) OVER (PARTITION BY func ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block FROM stmt")
def _(s, d):
    return longs(L.pieces(E.statements(s, d), F.col("op") == "store").select("func", "pos", "block"), "block")


@query("x4_def_ref", f"WITH {E.STMT} SELECT func, (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM (SELECT DISTINCT avar AS v FROM stmt i WHERE i.func = o.func)) AS defs, (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM (SELECT DISTINCT a AS v FROM stmt i WHERE i.func = o.func)) AS refs FROM (SELECT DISTINCT func FROM stmt) o")
def _(s, d):
    return L.def_ref(E.statements(s, d))


@query("pass22_inputs", f"WITH {E.STMT} SELECT DISTINCT func, a AS var FROM stmt EXCEPT SELECT func, avar FROM stmt")
def _(s, d):
    return L.inputs(E.statements(s, d))


@query("pass25_collapsible_loads", f"WITH {E.STMT}, {DEFS} SELECT u.func, u.pos, u.from_pos FROM uses u JOIN stmt l ON l.func = u.func AND l.pos = u.pos AND l.op = 'load' JOIN stmt st ON st.func = u.func AND st.pos = u.from_pos AND st.op = 'store'")
def _(s, d):
    return L.collapsible_loads(E.statements(s, d))


@query("pass29_dead_code", f"WITH RECURSIVE {E.STMT}, {DEFS}, roots AS (SELECT func, max(pos) AS pos FROM stmt GROUP BY func, avar UNION SELECT func, pos FROM stmt WHERE op = 'store'), live AS (SELECT * FROM roots UNION SELECT u.func, u.from_pos FROM live JOIN uses u ON u.func = live.func AND u.pos = live.pos WHERE u.from_pos IS NOT NULL) SELECT func, pos FROM stmt ANTI JOIN live USING (func, pos)")
def _(s, d):
    return L.dead_code(E.statements(s, d)).select("func", "pos")


@query("m12_g14_identical_functions", f"""WITH {E.STMT}, f AS (SELECT func, list(CAST(a AS INTEGER) ORDER BY pos) AS la, list(CAST(avar AS INTEGER) ORDER BY pos) AS lv, list(op || ':' || b ORDER BY pos) AS ops, count(*) AS n FROM stmt GROUP BY func),
g AS (SELECT func, n, ops, list_transform(generate_series(1, 2 * n), lambda i: CASE WHEN i % 2 = 1 THEN la[(i + 1) // 2] ELSE lv[i // 2] END) AS seq FROM f),
h AS (SELECT func, n, ops, list_transform(seq, lambda x: list_position(seq, x)) AS shape FROM g)
SELECT n, count(*) AS n_functions, count(DISTINCT CAST(ops AS VARCHAR) || CAST(shape AS VARCHAR)) AS n_shapes FROM h GROUP BY n""")
def _(s, d):
    return longs(L.identity(E.statements(s, d)).groupBy("n").agg(F.count("*").alias("n_functions"), F.count_distinct("shape").alias("n_shapes")), "n")


# Graphs


@query("g1_degrees", f"WITH {E.edge_sql()}, v AS (SELECT graph, src AS v, 1 AS o, 0 AS i FROM edge UNION ALL SELECT graph, dst, 0, 1 FROM edge) SELECT graph, v, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM v GROUP BY ALL")
def _(s, d):
    return G.degrees(E.edges(s, d))


@query("g2_exits", f"WITH {E.edge_sql()} SELECT graph, dst AS v FROM edge EXCEPT SELECT graph, src FROM edge")
def _(s, d):
    return G.exits(E.edges(s, d))


CLOSURE = "reach AS (SELECT DISTINCT graph, src, dst FROM edge UNION SELECT r.graph, r.src, e.dst FROM reach r JOIN edge e ON e.graph = r.graph AND e.src = r.dst)"


@query("g4_closure", f"WITH RECURSIVE {E.edge_sql()}, {CLOSURE} SELECT * FROM reach")
def _(s, d):
    return G.closure(E.edges(s, d))


@query("g3_depths", f"WITH RECURSIVE {E.edge_sql()}, walk AS (SELECT graph, min(v) AS v, 0 AS depth FROM (SELECT graph, src AS v FROM edge UNION ALL SELECT graph, dst FROM edge) GROUP BY graph UNION SELECT w.graph, e.dst, depth + 1 FROM walk w JOIN edge e ON e.graph = w.graph AND e.src = w.v WHERE depth < 6) SELECT graph, v, min(depth) AS depth FROM walk GROUP BY graph, v")
def _(s, d):
    e = E.edges(s, d)
    return G.depths(e, G.vertices(e).groupBy("graph").agg(F.min("v").alias("v")))


@query("g7_prune", f"WITH RECURSIVE {E.edge_sql()}, st AS (SELECT graph, min(src) AS v FROM edge GROUP BY graph), walk AS (SELECT * FROM st UNION SELECT w.graph, e.dst FROM walk w JOIN edge e ON e.graph = w.graph AND e.src = w.v) SELECT e.* FROM edge e JOIN walk w ON w.graph = e.graph AND w.v = e.src")
def _(s, d):
    e = E.edges(s, d)
    return G.reachable_only(e, e.groupBy("graph").agg(F.min("src").alias("v"))).select("graph", "src", "dst", "label")


@query("g5_g24_dataflow", f"WITH RECURSIVE {E.edge_sql()}, facts AS (SELECT DISTINCT graph, src AS v, dst AS fact FROM edge WHERE label), fl AS (SELECT * FROM facts UNION SELECT e.graph, e.dst, f.fact FROM fl f JOIN edge e ON e.graph = f.graph AND e.src = f.v WHERE f.v <> f.fact) SELECT * FROM fl")
def _(s, d):
    e = E.edges(s, d)
    facts = e.where("label").select("graph", F.col("src").alias("v"), F.col("dst").alias("fact"))
    return G.dataflow(e, facts, G.vertices(e).select("graph", "v", F.col("v").alias("fact")))


@query("g16_cycle_test", f"WITH RECURSIVE {E.edge_sql()}, {CLOSURE} SELECT graph, src AS v FROM reach WHERE src = dst")
def _(s, d):
    return G.cyclic(E.edges(s, d))


@query("g18_components", f"WITH RECURSIVE {E.edge_sql()}, {CLOSURE} SELECT graph, v, min(w) AS scc FROM (SELECT graph, src AS v, src AS w FROM edge UNION SELECT graph, dst, dst FROM edge UNION SELECT a.graph, a.src, a.dst FROM reach a JOIN reach b ON a.graph = b.graph AND a.src = b.dst AND a.dst = b.src) GROUP BY graph, v")
def _(s, d):
    return G.strong_components(E.edges(s, d))


@query("g17_virtual_sink", f"WITH {E.edge_sql()} SELECT * FROM edge UNION ALL SELECT graph, v, 'sink', NULL FROM (SELECT graph, dst AS v FROM edge EXCEPT SELECT graph, src FROM edge)")
def _(s, d):
    return G.virtual_sink(E.edges(s, d))


@query("g16_layers", f"""WITH RECURSIVE {E.edge_sql()}, {CLOSURE}, acyc AS (SELECT DISTINCT graph, src, dst FROM edge WHERE graph NOT IN (SELECT graph FROM reach WHERE src = dst)), vs AS (SELECT graph, src AS v FROM acyc UNION SELECT graph, dst FROM acyc),
up AS (SELECT graph, v, 0 AS layer FROM vs UNION SELECT a.graph, a.src, layer + 1 FROM up JOIN acyc a ON a.graph = up.graph AND a.dst = up.v) SELECT graph, v, max(layer) AS layer FROM up GROUP BY graph, v""")
def _(s, d):
    e = E.edges(s, d)
    return G.layers(e.join(G.cyclic(e).select("graph").distinct(), "graph", "left_anti").select("graph", "src", "dst", "label"))


@query("g6_dominators", f"""WITH RECURSIVE {E.edge_sql()}, vs AS (SELECT graph, src AS v FROM edge UNION SELECT graph, dst FROM edge), ent AS (SELECT graph, min(v) AS r FROM vs GROUP BY graph),
walk AS (SELECT graph, r AS v FROM ent UNION SELECT w.graph, e.dst FROM walk w JOIN edge e ON e.graph = w.graph AND e.src = w.v),
cut AS (SELECT w.graph, w.v AS x, ent.r AS v FROM walk w JOIN ent ON ent.graph = w.graph WHERE w.v <> ent.r UNION SELECT c.graph, c.x, e.dst FROM cut c JOIN edge e ON e.graph = c.graph AND e.src = c.v AND e.dst <> c.x),
dom AS (SELECT w.graph, o.v AS d, w.v FROM walk w JOIN walk o ON o.graph = w.graph AND o.v <> w.v ANTI JOIN cut c ON c.graph = w.graph AND c.x = o.v AND c.v = w.v)
SELECT w.graph, w.v, (SELECT count(*) FROM dom WHERE dom.graph = w.graph AND dom.v = w.v) AS depth, (SELECT count(*) FROM dom WHERE dom.graph = w.graph AND dom.d = w.v) AS n_dominated FROM walk w""")
def _(s, d):
    return G.dominators(E.edges(s, d)).select("graph", "v", "depth", "n_dominated")


@query("g13_isomorphic_graphs")
def _(s, d):
    return G.signatures(E.edges(s, d)).groupBy("signature").agg(F.count("*").alias("n"), F.min("graph").alias("first_graph"))


@query("g18_elementary_cycles")
def _(s, d):
    return G.cycles(E.edges(s, d))


@query("g3_walks")
def _(s, d):
    return G.walk(E.edges(s, d), min)


@query("g8_chains")
def _(s, d):
    return G.chains(E.edges(s, d))


@query("g9_drop_nops")
def _(s, d):
    e = E.edges(s, d)
    return G.coalesce_labels(e, G.vertices(e).where("v = 'error'"))


# Clusters


@query("c10_a24_stages", """SELECT count(*) AS n_initial, count(DISTINCT text) AS n_stage_1, count(DISTINCT regexp_replace(lower(text), '[^a-z]+', '', 'g')) AS n_stage_2 FROM documents""")
def _(s, d):
    t = E.table(s, d, "documents")
    return P.staged(t, F.col("text"), F.regexp_replace(F.lower("text"), "[^a-z]+", ""))


@query("c3_by_cardinality", f"WITH {E.STMT} SELECT n_defs, count(*) AS n FROM (SELECT func, count(DISTINCT avar) AS n_defs FROM stmt GROUP BY func) GROUP BY n_defs")
def _(s, d):
    return E.statements(s, d).groupBy("func").agg(F.count_distinct("avar").alias("n_defs")).groupBy("n_defs").agg(F.count("*").alias("n"))


@query("c4_n12_measure_vectors", f"WITH {E.STMT} SELECT vector, count(*) AS n FROM (SELECT func, count(*) % 64 + (count(DISTINCT avar) % 64) * 256 + (count(DISTINCT a) % 64) * 65536 AS vector FROM stmt GROUP BY func) GROUP BY vector")
def _(s, d):
    m = E.statements(s, d).groupBy("func").agg(F.count("*").alias("x"), F.count_distinct("avar").alias("y"), F.count_distinct("a").alias("z"))
    return m.select(P.measure_vector(F.col("x"), F.col("y"), F.col("z")).alias("vector")).groupBy("vector").agg(F.count("*").alias("n"))


@query("c11_symmetric_pairs", "SELECT DISTINCT least(l_partkey, l_suppkey) AS l, greatest(l_partkey, l_suppkey) AS r FROM lineitem")
def _(s, d):
    t = P.symmetric(E.table(s, d, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")
    return t.select(F.least("l_partkey", "l_suppkey").alias("l"), F.greatest("l_partkey", "l_suppkey").alias("r"))


@query("set_operations", """SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS n_both, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS n_first, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS n_any""")
def _(s, d):
    g = E.table(s, d, "orders").where("o_orderstatus in ('F', 'O')").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "O").alias("o"))
    return g.agg(F.count_if(F.col("f") & F.col("o")).alias("n_both"), F.count_if(F.col("f") & ~F.col("o")).alias("n_first"), F.count("*").alias("n_any"))


@query("a20_shared_names", """WITH RECURSIVE m AS (SELECT DISTINCT l_orderkey AS item, l_partkey * 10000000 + l_suppkey * 100 + l_linenumber AS name FROM lineitem),
l AS (SELECT item, item AS same FROM m UNION SELECT b.item, l.same FROM l JOIN m a ON a.item = l.item JOIN m b ON a.name = b.name) SELECT item, min(same) AS same FROM l GROUP BY item""")
def _(s, d):
    t = E.table(s, d, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_partkey") * 10000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("name"))
    return P.shared_names(t, "item", "name")


@query("j14_call_targets", """SELECT o_orderkey AS site, coalesce(c_name, s_name, 'unknown@' || o_custkey) AS target FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY') ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = o_custkey""")
def _(s, d):
    sites = E.table(s, d, "orders").select(F.col("o_orderkey").alias("site"), F.col("o_custkey").alias("addr"))
    funcs = E.table(s, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("start"), F.col("c_name").alias("symbol"))
    return P.resolved_calls(sites, funcs, E.table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("addr"), F.col("s_name").alias("symbol")))


@query("j16_ground_truth", """SELECT caller, callee, EXISTS (SELECT 1 FROM lineitem l JOIN part ON p_partkey = l_partkey WHERE l.l_suppkey = caller AND p_size = callee) AS hit FROM (SELECT DISTINCT o_custkey % 100 AS caller, o_orderkey % 50 AS callee FROM orders)""")
def _(s, d):
    span = lambda c: F.struct(F.col(c).cast("long").alias("lo"), (F.col(c) + 1).cast("long").alias("hi"))
    truth = E.table(s, d, "lineitem").join(E.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey").groupBy("l_suppkey").agg(F.collect_set(span("p_size")).alias("callee_ranges")).select(F.array(span("l_suppkey")).alias("caller_ranges"), "callee_ranges")
    pairs = E.table(s, d, "orders").select((F.col("o_custkey") % 100).alias("caller"), (F.col("o_orderkey") % 50).alias("callee")).distinct()
    return P.in_ground_truth(pairs, truth)


@query("j23_bucket_match", f"""WITH {E.INTERVAL}, a AS (SELECT base, lo, hi, count(*) AS k FROM access WHERE width > 4 GROUP BY ALL), b AS (SELECT base, lo, hi, count(*) AS k FROM access WHERE width > 8 GROUP BY ALL)
SELECT base, bool_and(coalesce(a.k = b.k, false)) AS matched FROM a FULL JOIN b USING (base, lo, hi) GROUP BY base""")
def _(s, d):
    x = E.intervals(s, d)
    return P.bucket_match(x.where("width > 4"), x.where("width > 8"), "base", ["lo", "hi"])


@query("a23_a26_reasons", "SELECT event_type, CASE WHEN value < 10 THEN 'bare' WHEN value < 50 THEN 'summarized' ELSE 'completed' END AS state, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    state = F.when(F.col("value") < 10, "bare").when(F.col("value") < 50, "summarized").otherwise("completed")
    return E.table(s, d, "events").groupBy("event_type", state.alias("state")).agg(F.count("*").alias("n"))


@query("a28_a29_instructions", f"WITH {E.STMT} SELECT func, count(*) AS n_instructions, count(DISTINCT op || ':' || a) AS n_expressions, count(DISTINCT a) AS n_inputs FROM stmt GROUP BY func")
def _(s, d):
    return E.statements(s, d).groupBy("func").agg(F.count("*").alias("n_instructions"), F.count_distinct(F.concat_ws(":", "op", F.col("a").cast("string"))).alias("n_expressions"), F.count_distinct("a").alias("n_inputs"))


def tree():
    """A statement's right side as a tree in JSON."""
    a, b = F.concat(F.lit('["var","v'), F.col("a").cast("string"), F.lit('",32]')), F.concat(F.lit('["int",'), F.col("b").cast("string"), F.lit(",32]"))
    load = F.concat(F.lit('["load",["var","mem",0],'), a, F.lit(",32]"))
    add = F.concat(F.lit('["bin","+",'), a, F.lit(","), b, F.lit("]"))
    sub = F.concat(F.lit('["bin","-",["bin","-",'), a, F.lit(","), b, F.lit('],["int",0,32]]'))
    return F.when(F.col("op") == "load", load).when(F.col("op") == "add", add).otherwise(sub)


@query("x1_transfer_functions", f"WITH {E.STMT} SELECT func, count(DISTINCT avar) AS n_outputs FROM stmt GROUP BY func")
def _(s, d):
    from ..operators.expressions import transfer_table

    return transfer_table(E.statements(s, d), tree()).groupBy("func").agg(F.count("*").alias("n_outputs"))


@query("m8_match_functions")
def _(s, d):
    from ..operators.expressions import transfer_table
    from ..operators.matching import match_pairs

    stmt = L.pieces(E.statements(s, d), F.col("op") == "store")
    many = 1 << 20  # blocks of a function
    flat = stmt.withColumn("func", F.col("func") * many + F.col("block"))
    entry = lambda b: F.when(b == 0, -4).otherwise(b).cast("int")
    side = lambda f: F.when(f % 2 == 0, "left").otherwise("right")
    func, block = F.shiftright("func", 20), (F.col("func") % many).cast("int")
    blocks = transfer_table(flat, tree()).select((func - func % 2).alias("cluster"), side(func).alias("side"), entry(block).alias("block"), "output", "tree")
    n = stmt.select("func", "block").distinct().withColumn("next", F.lead("block").over(Window.partitionBy("func").orderBy("block"))).where("next is not null")
    edges = n.select((F.col("func") - F.col("func") % 2).alias("cluster"), side(F.col("func")).alias("side"), entry(F.col("block")).alias("src"), entry(F.col("next")).alias("dst"), F.lit(None).cast("boolean").alias("label"))
    return match_pairs(blocks, edges).groupBy("fuzz", "overlap").agg(F.count("*").alias("n"), F.sum("n").alias("n_blocks"))


@query("j2_seed_pairs", f"WITH {E.STMT}, e AS (SELECT func, min(pos) AS pos FROM stmt GROUP BY func) SELECT a.func AS l, b.func AS r FROM e a JOIN stmt x ON x.func = a.func AND x.pos = a.pos JOIN e b ON b.func = a.func + 1 AND a.func % 2 = 0 JOIN stmt y ON y.func = b.func AND y.pos = b.pos WHERE x.op = y.op")
def _(s, d):
    first = E.statements(s, d).where("pos = 1")
    left = first.where("func % 2 = 0").select((F.col("func") + 1).alias("r"), F.col("func").alias("l"), "op")
    return left.join(first.select(F.col("func").alias("r"), "op"), ["r", "op"]).select("l", "r")


@query("p15_p17_addresses", f"""WITH {E.STMT}, x AS (SELECT *, CASE WHEN op = 'load' THEN a * 16 + b END AS addr FROM stmt)
SELECT func, pos, (SELECT arg_max(y.addr, y.pos) FROM x y WHERE y.func = x.func AND y.pos <= x.pos AND y.addr IS NOT NULL) AS running, (SELECT arg_min(y.addr, y.pos) FROM x y WHERE y.func = x.func AND y.addr IS NOT NULL) AS first_addr FROM x""")
def _(s, d):
    x = E.statements(s, d).withColumn("addr", F.when(F.col("op") == "load", F.col("a") * 16 + F.col("b")))
    whole = Window.partitionBy("func").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return x.select("func", "pos", F.last("addr", ignorenulls=True).over(L.upto()).alias("running"), F.first("addr", ignorenulls=True).over(whole).alias("first_addr"))


@query("f4_outside_range", "SELECT p_partkey FROM part WHERE p_retailprice IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT n_nationkey * 40 + 900 AS s, n_nationkey * 40 + 920 AS e FROM nation) WHERE p_retailprice >= s AND p_retailprice < e)")
def _(s, d):
    plt = E.table(s, d, "nation").select((F.col("n_nationkey") * 40 + 900).alias("s"), (F.col("n_nationkey") * 40 + 920).alias("e"))
    p = E.table(s, d, "part").select("p_partkey", "p_retailprice").where("p_retailprice is not null")
    return p.join(I.in_range(p, plt, "p_retailprice", "s", "e", 100).select("p_partkey"), "p_partkey", "left_anti").select("p_partkey")


@query("f5_blacklist", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src7', 'src11', 'src13')")
def _(s, d):
    black = s.createDataFrame([("src1",), ("src7",), ("src11",), ("src13",)], "source string")
    return E.table(s, d, "documents").select("doc_id", "source").join(F.broadcast(black), "source", "left_anti").select("doc_id", "source")


@query("k9_snapshots", f"""WITH {E.STMT} SELECT func, pos AS no, op AS name, coalesce(lag(a) OVER w <> a, false) AS changed, coalesce(lag(avar) OVER w <> avar, false) AS cfg_changed FROM stmt WINDOW w AS (PARTITION BY func ORDER BY pos)""")
def _(s, d):
    from ..sources.sinks import snapshots

    return snapshots(E.statements(s, d).select("func", F.col("pos").alias("no"), F.col("op").alias("name"), F.col("a").alias("stmts_hash"), F.col("avar").alias("edges_hash")))


@query("g10_common_ends", f"""WITH {E.STMT}, r AS (SELECT func % 50 AS g, func, op, row_number() OVER (PARTITION BY func ORDER BY pos DESC) AS k FROM stmt), n AS (SELECT g, count(DISTINCT func) AS m FROM r GROUP BY g),
p AS (SELECT g, k, count(*) AS c, count(DISTINCT op) AS v FROM r GROUP BY g, k), bad AS (SELECT p.g, min(k) AS k FROM p JOIN n ON n.g = p.g WHERE c <> m OR v > 1 GROUP BY p.g)
SELECT n.g, coalesce((SELECT k - 1 FROM bad WHERE bad.g = n.g), (SELECT max(k) FROM p WHERE p.g = n.g)) AS length FROM n""")
def _(s, d):
    ops = E.statements(s, d).groupBy("func").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("pos", "op"))), lambda x: x["op"])).alias("ops"))
    return longs(L.common_prefix(ops.withColumn("g", F.col("func") % 50), "g", "ops"), "length")
