"""Queries over plans of comparisons, block clusters and visibility, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import batches as B
from ..operators import blocks as K
from ..operators import graphs as G
from . import encode as E
from .registry import CLOSURE, query, res

NAMES = "prim, compiler, version, olevel, symbol, addr"


@query("p4_subject_of_key", rf"""WITH {E.SUBJECT}, k AS (SELECT id, CASE WHEN id % 7 = 0 THEN symbol ELSE concat_ws('-', prim, compiler, version, olevel, symbol) END AS k FROM subject)
SELECT id, CASE WHEN ok THEN split_part(k, '-', 1) END AS prim, CASE WHEN ok THEN split_part(k, '-', 5) END AS symbol, CASE WHEN ok THEN 0 END AS addr,
  CASE WHEN ok THEN concat_ws('-', split_part(k, '-', 2), split_part(k, '-', 3), split_part(k, '-', 1), split_part(k, '-', 4)) END AS path FROM (SELECT *, len(string_split(k, '-')) = 5 AS ok FROM k)""")
def _(s, d):
    k = E.subjects(s, d).select("id", F.when(F.col("id") % 7 == 0, F.col("symbol")).otherwise(F.concat_ws("-", "prim", "compiler", "version", "olevel", "symbol")).alias("k"))
    return k.withColumn("x", B.of_key(F.col("k"))).select("id", "x.prim", "x.symbol", "x.addr", "x.path")


@query("p5_subject_of_binary", f"""WITH {E.SUBJECT} SELECT id, CASE WHEN id % 5 > 0 THEN prim END AS prim, CASE WHEN id % 5 > 0 THEN version END AS version, CASE WHEN id % 5 > 0 THEN olevel END AS olevel, CASE WHEN id % 5 > 0 THEN addr END AS addr FROM subject""")
def _(s, d):
    t = E.subjects(s, d)
    name = F.concat_ws("-", F.when(F.col("id") % 5 == 0, "icc").otherwise(F.col("compiler")), "version", "olevel", "prim")
    return t.select("id", B.of_binary(F.concat(F.lit("/build/x-y/"), name), F.col("symbol"), F.col("addr")).alias("x")).select("id", "x.prim", "x.version", "x.olevel", "x.addr")


@query("p6_last_fields", f"""WITH {E.SUBJECT} SELECT id, concat_ws('-', compiler, prim) AS prog, symbol, addr FROM subject WHERE id % 3 > 0 UNION ALL SELECT id, NULL, NULL, NULL FROM subject WHERE id % 3 = 0""")
def _(s, d):
    t = E.subjects(s, d)
    text = F.concat_ws("-", "compiler", "prim", "symbol", F.when(F.col("id") % 3 == 0, "not hex").otherwise(B.hexadecimal(F.col("addr"))))
    return t.select("id", B.last_fields(text).alias("x")).select("id", "x.prog", "x.symbol", "x.addr")


@query("p9_p10_names", f"""WITH {E.SUBJECT}, x AS (SELECT a.id, a.compiler || '-' || a.symbol || '-' || lower(printf('%x', a.addr)) || '--' || b.compiler || '-' || b.symbol || '-' || lower(printf('%x', b.addr)) AS tag,
  repeat(a.symbol || '_', 30) AS long, lower(printf('%x', a.addr)) AS h FROM subject a JOIN subject b ON b.id = a.id + 1)
SELECT id, tag, left(long, 249 - length(h)) || '-' || h AS dir FROM x""")
def _(s, d):
    a = E.subjects(s, d).select("id", "compiler", "symbol", "addr")
    b = a.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"r_{c}") for c in ("compiler", "symbol", "addr")])
    long = F.repeat(F.concat("symbol", F.lit("_")), F.lit(30))
    return a.join(b, "id").select("id", B.pair_tag(*[F.col(c) for c in ("compiler", "symbol", "addr", "r_compiler", "r_symbol", "r_addr")]).alias("tag"), B.function_dir(long, F.col("addr")).alias("dir"))


@query("f2_selected", f"WITH {E.SUBJECT} SELECT id, prim FROM subject WHERE prim IN ('economy', 'promo')")
def _(s, d):
    return B.selected(B.selected(E.subjects(s, d), "prim", ["economy", "promo"]), "symbol", []).select("id", "prim")


NUMBERS = "string_split(version, '.')::INTEGER[]"
VERSIONS = f"ver AS (SELECT DISTINCT compiler, version, split_part(version, '.', 1) || '.' || split_part(version, '.', 2) AS grp, {NUMBERS} AS k FROM subject)"


@query("b2_b3_version_pairs", f"""WITH {E.SUBJECT}, {VERSIONS} SELECT 'adjacent' AS mode, compiler, grp AS "group", version AS l, r FROM (SELECT *, lead(version) OVER (PARTITION BY compiler, grp ORDER BY k) AS r FROM ver) WHERE r IS NOT NULL
UNION ALL SELECT 'unique', a.compiler, a.grp, a.version, b.version FROM ver a JOIN ver b ON a.compiler = b.compiler AND a.grp = b.grp AND a.k < b.k
UNION ALL SELECT 'all', compiler, 'All', version, r FROM (SELECT *, lead(version) OVER (PARTITION BY compiler ORDER BY k) AS r FROM ver) WHERE r IS NOT NULL""")
def _(s, d):
    t = E.subjects(s, d)
    parts = [B.version_pairs(t, "major", "adjacent").withColumn("mode", F.lit("adjacent")), B.version_pairs(t, "major", "unique").withColumn("mode", F.lit("unique")), B.version_pairs(t, "all").withColumn("mode", F.lit("all"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


BATCH = f"""{E.SUBJECT}, {VERSIONS}, vp AS (SELECT compiler, version AS l, lead(version) OVER (PARTITION BY compiler, grp ORDER BY k) AS r FROM ver),
bin AS (SELECT DISTINCT prim, compiler, version, olevel, '/build/' || prim || '/' || compiler || '-' || version || '-' || olevel || '-' || prim AS path FROM subject), im AS (SELECT DISTINCT prim, unnest(['fast', 'plain']) AS implementation FROM subject),
sym AS (SELECT path, implementation || '_' || prim AS symbol, CAST(length(path) * 64 + CASE implementation WHEN 'fast' THEN 1 ELSE 2 END AS BIGINT) AS addr FROM bin JOIN im USING (prim) WHERE NOT (implementation = 'fast' AND olevel = 'O0')),
pairs AS (SELECT a.prim, a.compiler, a.olevel, i.implementation, x.symbol, a.version AS l_version, b.version AS r_version, a.path AS l_path, b.path AS r_path, x.addr AS l_addr, y.addr AS r_addr,
  a.prim || '/' || a.compiler || '-' || a.version || '-' || a.olevel || '_vs_' || a.compiler || '-' || b.version || '-' || a.olevel || '-' || a.prim || '.batch' AS batch
  FROM vp JOIN bin a ON a.compiler = vp.compiler AND a.version = vp.l JOIN bin b ON b.compiler = vp.compiler AND b.version = vp.r AND b.prim = a.prim AND b.olevel = a.olevel JOIN im i ON i.prim = a.prim
  JOIN sym x ON x.path = a.path AND x.symbol = i.implementation || '_' || a.prim JOIN sym y ON y.path = b.path AND y.symbol = x.symbol)"""


def planned(s, d):
    t = E.subjects(s, d)
    name = F.concat_ws("-", "compiler", "version", "olevel", "prim")
    binaries = t.select("prim", "compiler", "version", "olevel", F.concat(F.lit("/build/"), "prim", F.lit("/"), name).alias("path")).distinct()
    prims = t.select("prim").distinct().withColumn("implementation", F.explode(F.array(F.lit("fast"), F.lit("plain"))))
    addr = F.length("path") * 64 + F.when(F.col("implementation") == "fast", 1).otherwise(2)
    symbols = binaries.join(prims, "prim").where("not (implementation = 'fast' and olevel = 'O0')").select("path", F.concat_ws("_", "implementation", "prim").alias("symbol"), addr.cast("long").alias("addr"))
    return B.batch_pairs(B.version_pairs(t), prims, binaries, symbols)


@query("b1_b4_batch_pairs", f"WITH {BATCH} SELECT * FROM pairs")
def _(s, d):
    return planned(s, d)


@query("b10_k7_manifest", f"""WITH {BATCH} SELECT 'left' AS side, implementation, prim, compiler, l_version AS version, olevel, l_path AS path FROM pairs UNION ALL SELECT 'right', implementation, prim, compiler, r_version, olevel, r_path FROM pairs""")
def _(s, d):
    return B.manifest(planned(s, d))


@query("k6_batch_files", f"WITH {BATCH} SELECT batch, count(*) AS n FROM pairs GROUP BY batch")
def _(s, d):
    return planned(s, d).groupBy("batch").agg(F.count("*").alias("n"))


@query("b6_s9_inline_pairs", """WITH x AS (SELECT l_suppkey AS b, l_orderkey AS caller, l_linenumber AS k, l_partkey, l_orderkey * 16 AS lo, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey * 32 END AS callee FROM lineitem)
SELECT CAST(b AS VARCHAR) AS "binary", 'f' || caller AS l_name, lo AS l_addr, 'g' || l_partkey AS r_name, callee AS r_addr FROM x WHERE callee IS NOT NULL""")
def _(s, d):
    return B.of_inlines(inlines(s, d))[0]


def inlines(s, d):
    t = E.table(s, d, "lineitem")
    span = lambda c, k: F.struct((F.col(c) * k).alias("lo"), (F.col(c) * k + 8).alias("hi"))
    none = F.array().cast("array<array<struct<lo:bigint,hi:bigint>>>")
    return t.select(F.col("l_suppkey").cast("string").alias("binary"), F.concat(F.lit("f"), "l_orderkey").alias("caller"), F.array(span("l_orderkey", 16)).alias("caller_ranges"), F.concat(F.lit("g"), "l_partkey").alias("inline"), F.when(F.col("l_linenumber") % 3 > 0, F.array(F.array(span("l_partkey", 32)))).otherwise(none).alias("callee_ranges"))


@query("b6_inline_starts", """SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS "binary", l_orderkey * 16 AS addr FROM lineitem WHERE l_linenumber % 3 > 0""")
def _(s, d):
    return B.of_inlines(inlines(s, d))[1]


@query("j9_enriched", f"WITH {E.RESULT} SELECT r.id, r.fuzz, o.o_custkey AS planned_cust FROM result r JOIN orders o ON o.o_orderkey = r.id")
def _(s, d):
    plan = E.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("planned_cust"))
    return B.enriched(res(s, d).select("id", "fuzz"), plan, "id")


@query("j21_aligned_children", "SELECT p_name, CASE WHEN a AND b THEN 'both' WHEN a THEN 'left' ELSE 'right' END AS side FROM (SELECT p_name, bool_or(p_size <= 20) AS a, bool_or(p_size > 30) AS b FROM part WHERE p_size <= 20 OR p_size > 30 GROUP BY p_name)")
def _(s, d):
    p = E.table(s, d, "part")
    return B.aligned(p.where("p_size <= 20"), p.where("p_size > 30"), "p_name")


@query("c12_chunks", "SELECT count(*) AS n_rows, count(DISTINCT p_name) AS n_names, true AS together FROM part")
def _(s, d):
    c = B.chunked(E.table(s, d, "part"), "p_name", 7)
    return c.groupBy("p_name").agg(F.count("*").alias("n"), F.count_distinct("chunk").alias("k")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_names"), F.bool_and(F.col("k") == 1).alias("together"))


@query("c13_speedup", "SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, max(value) AS wall, round(sum(value) / max(value), 6) AS speedup FROM events GROUP BY event_type")
def _(s, d):
    e = E.table(s, d, "events")
    return B.speedup(e.withColumn("wall", F.col("value")), "value", "wall", "event_type")


@query("u1_call_sites", "SELECT DISTINCT l_orderkey AS func, l_orderkey * 1000 + l_partkey AS site, l_partkey % 9 AS callee FROM lineitem")
def _(s, d):
    t = E.table(s, d, "lineitem")
    return B.call_sites(t.select(F.col("l_orderkey").alias("func"), (F.col("l_orderkey") * 1000 + F.col("l_partkey")).alias("site"), (F.col("l_partkey") % 9).alias("callee")))


@query("a18_partition", f"WITH {E.RESULT} SELECT coalesce(fuzz, 'none') AS class, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM result GROUP BY 1")
def _(s, d):
    from ..operators.classify import partitioned

    p = partitioned(res(s, d), F.coalesce("fuzz", F.lit("none")), "id")
    return p.select("class", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("ids"))


@query("a8_checked_total", f"WITH {E.RESULT} SELECT symbol, count(*) AS n_all, (SELECT count(*) FROM result) AS n_input FROM result GROUP BY symbol")
def _(s, d):
    from ..operators.classify import checked_total, summary

    r = res(s, d)
    return checked_total(summary(r, "symbol"), r).select("symbol", "n_all", "n_input")


@query("a19_checked_ranges", "SELECT s_nationkey * 100 AS start, s_nationkey * 100 + 50 AS \"end\", string_agg(s_name, ',' ORDER BY s_name) AS names FROM supplier GROUP BY s_nationkey")
def _(s, d):
    from ..operators.classify import function_ranges

    t = E.table(s, d, "supplier").select((F.col("s_nationkey") * 100).alias("start"), (F.col("s_nationkey") * 100 + 50).alias("end"), F.col("s_name").alias("name"))
    return function_ranges(t).withColumn("names", F.array_join("names", ","))


# Sets


@query("sets_of_lists", """WITH a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS q FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_custkey, list_has_all(q, p) AS is_subset, list_has_all(p, q) AS is_superset FROM a JOIN b USING (o_custkey)""")
def _(s, d):
    o = E.table(s, d, "orders")
    of = lambda x, n: o.where(F.col("o_orderstatus") == x).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias(n))
    return of("F", "p").join(of("O", "q"), "o_custkey").select("o_custkey", S.is_subset(F.col("p"), F.col("q")).alias("is_subset"), S.is_subset(F.col("q"), F.col("p")).alias("is_superset"))


@query("set_permutations", """WITH x AS (SELECT DISTINCT o_orderpriority AS p FROM orders) SELECT a.p || ',' || b.p || ',' || c.p AS items FROM x a, x b, x c WHERE a.p <> b.p AND b.p <> c.p AND a.p <> c.p""")
def _(s, d):
    one = E.table(s, d, "orders").groupBy().agg(F.array_sort(F.collect_set("o_orderpriority")).alias("x"))
    return one.select(F.explode(S.arrangements(F.col("x"), 3)).alias("p")).select(F.array_join("p", ",").alias("items"))


@query("set_subsumption", "SELECT user_id, event_type, true AS stays FROM (SELECT DISTINCT user_id, event_type FROM events) e WHERE event_type = 'error' OR NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.value > 80)")
def _(s, d):
    from ..operators.classify import without_subsumed

    e = E.table(s, d, "events")
    every = e.where("event_type = 'error' and value > 80").select("user_id").distinct()
    return without_subsumed(e.select("user_id", "event_type").distinct(), every, ["user_id"], F.col("event_type") != "error").withColumn("stays", F.lit(True))


@query("o7_n17_lists", """WITH x AS (SELECT l_orderkey AS func, list(l_linenumber ORDER BY l_linenumber) AS v FROM lineitem GROUP BY 1)
SELECT func, array_to_string(v[1:2], ',') AS first_two, array_to_string(v[3:], ',') AS rest, array_to_string(list_resize(v, greatest(8, len(v)), 0), ',') AS padded FROM x""")
def _(s, d):
    v = E.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("func")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("v"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    c = F.col("v")
    return v.select("func", text(S.take(c, 2)).alias("first_two"), text(S.drop(c, 2)).alias("rest"), text(S.padded(c, 8, F.lit(0))).alias("padded"))


@query("n2_n4_interval_tests", f"WITH {E.INTERVAL} SELECT base, lo, hi, hi < 100 AS below, lo > 100 AS above, hi - lo + 1 AS size FROM access")
def _(s, d):
    from ..operators.intervals import size, strictly_above, strictly_below

    x = E.intervals(s, d)
    return x.select("base", "lo", "hi", strictly_below(F.col("hi"), F.lit(100)).alias("below"), strictly_above(F.col("lo"), F.lit(100)).alias("above"), size(F.col("lo"), F.col("hi")).alias("size"))


# Block clusters


BLOCKS = """block AS (SELECT l_orderkey AS graph, l_linenumber AS block, l_partkey AS addr, CASE WHEN l_linenumber % 5 > 0 THEN l_suppkey % 8 END AS n_outputs, l_quantity AS q FROM lineitem)"""


def blocks(s, d):
    t = E.table(s, d, "lineitem")
    return t.select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("block"), F.col("l_partkey").alias("addr"), F.when(F.col("l_linenumber") % 5 > 0, F.col("l_suppkey") % 8).alias("n_outputs"), F.col("l_quantity").cast("long").alias("q"), F.array(F.concat(F.lit("f"), "l_orderkey"), F.concat(F.lit("g"), (F.col("l_orderkey") % 10))).alias("symbols"))


@query("c1_c2_clusters_by_function", f"WITH {BLOCKS}, c AS (SELECT 'f' || graph AS key, graph, block FROM block WHERE n_outputs IS NOT NULL UNION ALL SELECT 'g' || (graph % 10), graph, block FROM block WHERE n_outputs IS NOT NULL) SELECT key, count(*) AS n FROM c GROUP BY key")
def _(s, d):
    return K.block_clusters(blocks(s, d), "function").groupBy("key").agg(F.count("*").alias("n"))


@query("c1_c3_c4_clusters_by_measures", f"WITH {BLOCKS} SELECT bin(n_outputs % 64 + (CAST(q AS BIGINT) % 64) * 256) AS key, count(*) AS n FROM block WHERE n_outputs IS NOT NULL GROUP BY key UNION ALL SELECT 'n' || n_outputs, count(*) FROM block WHERE n_outputs IS NOT NULL GROUP BY 1")
def _(s, d):
    b = blocks(s, d)
    count = lambda c: c.groupBy("key").agg(F.count("*").alias("n"))
    return count(K.block_clusters(b, "measures", "n_outputs", "q")).unionByName(count(K.block_clusters(b, "cardinality").withColumn("key", F.concat(F.lit("n"), "key"))))


@query("c5_clusters_by_tag", f"WITH {BLOCKS}, t AS (SELECT p_partkey AS addr, unnest([lower(p_type), p_brand]) AS tag FROM part WHERE p_size > 10) SELECT tag AS key, count(*) AS n FROM (SELECT DISTINCT addr, tag FROM t) JOIN block USING (addr) WHERE n_outputs IS NOT NULL GROUP BY tag")
def _(s, d):
    tags = E.table(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("addr"), F.explode(F.array(F.lower("p_type"), F.col("p_brand"))).alias("tag"))
    return K.block_clusters(K.with_tags(blocks(s, d), tags), "tag").groupBy("key").agg(F.count("*").alias("n"))


CL = "cl AS (SELECT DISTINCT c_nationkey AS key, c_custkey AS item FROM customer), eq AS (SELECT l_suppkey AS l, l_partkey AS r FROM lineitem UNION SELECT l_partkey, l_suppkey FROM lineitem UNION SELECT item, item FROM cl)"


@query("c9_single_clusters", f"WITH {CL}, rep AS (SELECT key, min(item) AS item FROM cl GROUP BY key) SELECT DISTINCT a.key AS a, b.key AS b FROM rep a JOIN eq ON eq.l = a.item JOIN rep b ON b.item = eq.r WHERE a.key < b.key")
def _(s, d):
    return K.equivalent_clusters(*cluster_links(s, d))


def cluster_links(s, d):
    return E.table(s, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("item")), E.table(s, d, "lineitem").select(F.col("l_suppkey").alias("l"), F.col("l_partkey").alias("r"))


@query("c9_exhaustive_clusters", f"WITH {CL} SELECT DISTINCT a.key AS a, b.key AS b FROM cl a JOIN eq ON eq.l = a.item JOIN cl b ON b.item = eq.r WHERE a.key < b.key")
def _(s, d):
    return K.equivalent_clusters(*cluster_links(s, d), exhaustive=True)


@query("c7_c8_buckets", "SELECT o_custkey AS grp, CAST(count(*) AS BIGINT) AS n, CAST(min(o_orderkey) AS BIGINT) AS first, k % 7 AS key FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS k FROM orders) GROUP BY o_custkey, k % 7")
def _(s, d):
    from ..operators.pairs import bucket_table

    o = E.table(s, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("item"), F.floor("o_totalprice").cast("long").alias("value"))
    b = bucket_table(o, lambda a, b: a % 7 == b % 7)
    return b.groupBy("grp", "first").agg(F.count("*").alias("n"), F.min(F.col("value") % 7).alias("key"))


# Visibility


FLOW = f"""{E.edge_sql()}, ev AS (SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS graph, event_type AS block, event_id, ts, value FROM events),
sq AS (SELECT *, lag(event_id) OVER w AS p1, lag(event_id, 2) OVER w AS p2 FROM ev WINDOW w AS (PARTITION BY graph ORDER BY ts, event_id)),
def AS (SELECT graph, 'v' || event_id AS var, block FROM sq), used AS (SELECT DISTINCT graph, 'v' || p1 AS var, block FROM sq WHERE p1 IS NOT NULL AND value < 60 UNION SELECT graph, 'v' || p2, block FROM sq WHERE p2 IS NOT NULL UNION SELECT graph, 'in', block FROM sq WHERE value > 90)"""
VISIBLE = "vis AS (SELECT DISTINCT d.graph, d.var, r.dst AS block FROM def d JOIN reach r ON r.graph = d.graph AND r.src = d.block)"
USEFUL = """usef AS (SELECT * FROM used UNION SELECT u.graph, u.var, r.src FROM used u JOIN reach r ON r.graph = u.graph AND r.dst = u.block LEFT JOIN def d ON d.graph = u.graph AND d.var = u.var
  WHERE d.var IS NULL OR (u.block <> d.block AND EXISTS (SELECT 1 FROM vis WHERE vis.graph = u.graph AND vis.var = u.var AND vis.block = r.src)))"""


def flow(s, d):
    """(edges, definitions, uses) of users' days: an event defines a variable in its block, and later ones use it."""
    from pyspark.sql import Window

    e = E.table(s, d, "events")
    w = Window.partitionBy("graph").orderBy("ts", "event_id")
    t = e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("graph"), F.col("event_type").alias("block"), "event_id", "ts", "value").withColumns({"p1": F.lag("event_id").over(w), "p2": F.lag("event_id", 2).over(w)})
    var = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    uses = F.array_compact(F.array(F.when(F.col("value") < 60, var("p1")), var("p2"), F.when(F.col("value") > 90, F.lit("in"))))
    return E.edges(s, d), t.select("graph", var("event_id").alias("var"), "block"), t.select("graph", F.explode(uses).alias("var"), "block").distinct()


@query("x3_visible", f"WITH RECURSIVE {FLOW}, {CLOSURE}, {VISIBLE} SELECT * FROM vis")
def _(s, d):
    edges, defs, _ = flow(s, d)
    return K.visible(edges, defs)


@query("x3_useful", f"WITH RECURSIVE {FLOW}, {CLOSURE}, {VISIBLE}, {USEFUL} SELECT * FROM usef")
def _(s, d):
    return K.useful(*flow(s, d))


OUT = """outp AS (SELECT d.graph, d.var, d.block, EXISTS (SELECT 1 FROM usef u WHERE u.graph = d.graph AND u.var = d.var AND u.block <> d.block) OR NOT EXISTS (SELECT 1 FROM edge e WHERE e.graph = d.graph AND e.src = d.block) AND EXISTS (SELECT 1 FROM edge e WHERE e.graph = d.graph AND e.dst = d.block) AND substr(d.var, 2) LIKE '%7' AS is_visible FROM def d)"""


@query("x3_outputs", f"WITH RECURSIVE {FLOW}, {CLOSURE}, {VISIBLE}, {USEFUL}, {OUT} SELECT * FROM outp")
def _(s, d):
    edges, defs, uses = flow(s, d)
    named = lambda t: t.withColumn("var", F.when(F.col("var").rlike("^v.*7$"), F.concat(F.lit("eax."), F.col("var"))).otherwise(F.col("var")))
    return K.visible_outputs(edges, named(defs), named(uses), result="eax").withColumn("var", F.regexp_replace("var", r"^eax\.", ""))


@query("f12_kept_outputs", f"""WITH RECURSIVE {FLOW}, {CLOSURE}, {VISIBLE}, {USEFUL}, {OUT}, k AS (SELECT *, CAST(substr(var, 2) AS BIGINT) % 5 AS m, CAST(substr(var, 2) AS BIGINT) % 3 AS w FROM outp)
SELECT graph, var, CASE WHEN m = 1 THEN w = 1 OR is_visible WHEN m IN (2, 3) THEN true ELSE is_visible END AS visible FROM k WHERE NOT (m = 4 AND w = 0)""")
def _(s, d):
    edges, defs, uses = flow(s, d)
    named = lambda t: t.withColumn("var", F.when(F.col("var").rlike("^v.*7$"), F.concat(F.lit("eax."), F.col("var"))).otherwise(F.col("var")))
    out = K.visible_outputs(edges, named(defs), named(uses), result="eax").withColumn("var", F.regexp_replace("var", r"^eax\.", ""))
    out = out.withColumn("n", F.substring("var", 2, 20).cast("long"))
    n = F.col("n")
    kind = F.when(n % 5 == 1, "stack").when(n % 5 == 2, "array").when(n % 5 == 3, "mem").otherwise("reg")
    out = out.withColumns({"kind": kind, "high": F.lit(-4), "own": F.col("var")}).withColumn("var", F.when(n % 5 == 4, F.concat(F.lit("esp."), "own")).otherwise(F.col("own")))
    return K.kept_outputs(out, n % 3 == 0, n % 3 == 1).select("graph", F.col("own").alias("var"), "visible")


@query("m6_visible_assumptions", f"WITH {E.SUBJECT}, a AS (SELECT l_suppkey % 40 AS l, l_partkey % 40 AS r FROM lineitem) SELECT DISTINCT l, r FROM a WHERE l % 3 > 0 AND r % 4 > 0")
def _(s, d):
    t = E.table(s, d, "lineitem").select((F.col("l_suppkey") % 40).alias("l"), (F.col("l_partkey") % 40).alias("r")).distinct()
    seen = lambda c, k: t.where(F.col(c) % k > 0).select(F.col(c).alias("var")).distinct()
    return K.visible_assumptions(t, seen("l", 3), seen("r", 4)).select("l", "r")


@query("g31_frontier", f"""WITH {E.edge_sql()}, m AS (SELECT DISTINCT graph, src AS l, src AS r FROM edge WHERE src < 'error'), lc AS (SELECT e.graph, e.src AS l, count(DISTINCT e.dst) AS n, count(DISTINCT e.dst) FILTER (WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.graph = e.graph AND m.l = e.dst)) AS o FROM edge e GROUP BY ALL),
rc AS (SELECT e.graph, e.src AS r, count(DISTINCT e.dst) AS n, count(DISTINCT e.dst) FILTER (WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.graph = e.graph AND m.r = e.dst)) AS o FROM edge e WHERE e.label IS NULL GROUP BY ALL),
x AS (SELECT m.*, coalesce(lc.n, 0) AS ln, coalesce(lc.o, 0) AS lo, coalesce(rc.n, 0) AS rn, coalesce(rc.o, 0) AS ro FROM m LEFT JOIN lc ON lc.graph = m.graph AND lc.l = m.l LEFT JOIN rc ON rc.graph = m.graph AND rc.r = m.r)
SELECT graph, l, r FROM x WHERE (lo > 0 AND ro > 0) OR (lo > 0 AND rn = 0) OR (ln = 0 AND ro > 0) OR (ln = 0 AND rn = 0)""")
def _(s, d):
    e = E.edges(s, d)
    m = e.where("src < 'error'").select("graph", F.col("src").alias("l"), F.col("src").alias("r")).distinct()
    return K.frontier(m, e, e.where("label is null"))


@query("g2_checked_exits", f"WITH {E.edge_sql()}, x AS (SELECT graph, dst AS v FROM edge EXCEPT SELECT graph, src FROM edge) SELECT graph, v FROM x UNION ALL SELECT graph, NULL FROM (SELECT DISTINCT graph FROM edge) WHERE graph NOT IN (SELECT graph FROM x)")
def _(s, d):
    return G.exits_or_none(E.edges(s, d))
