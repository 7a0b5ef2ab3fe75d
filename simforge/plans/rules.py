"""Queries over rewriting rules, evaluation, and texts that are written and read again, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import batches as B
from ..operators import expressions as X
from ..operators import pairs as P
from ..operators.tables import spread
from ..sources import files as R
from ..sources import sexp
from . import encode as E
from .registry import query, res

A, C = '["var","a",32]', '["var","b",32]'
BYTE = '["load",["var","mem",0],["var","a",32],8]'
#: (rule, tree, its normal form). {k}: a number from 1 up, {n}: its negative in 32 bits, {s}: its sum with 7, {m}: its mask.
CASES = [
    ("T1", '["val",["val",["var","a",32]]]', A),
    ("T2", f'["bin","+",["val",{A}],["val",["int",{{k}},32]]]', f'["bin","+",{A},["int",{{k}},32]]'),
    ("T3", f'["bin","&",["bin",">>",{A},["int",7,32]],["int",1,32]]', f'["bin",">>",["cast","signed",32,["cast","low",8,{A}]],["int",31,32]]'),
    ("T4", f'["bin","+",{A},["un","-",{C}]]', f'["bin","-",{A},{C}]'),
    ("T4", f'["bin","+",{A},["int",{{n}},32]]', f'["bin","-",{A},["int",{{k}},32]]'),
    ("T5", f'["bin","-",["bin","-",{A},{C}],["int",{{k}},32]]', f'["bin","-",{A},["bin","+",{C},["int",{{k}},32]]]'),
    ("T6", f'["bin","-",{A},["bin","+",["int",{{k}},32],["int",7,32]]]', f'["bin","-",{A},["int",{{s}},32]]'),
    ("T6", f'["bin","+",["int",0,32],["bin","-",{A},["int",0,32]]]', A),
    ("T7", '["bin","==",["cast","unsigned",32,["var","c",8]],["int",0,32]]', '["bin","==",["var","c",8],["int",0,8]]'),
    ("T8", f'["bin","==",["bin","==",{A},["int",0,32]],["int",0,1]]', f'["un","~",["bin","==",{A},["int",0,32]]]'),
    ("T9", f'["cast","low",8,["cast","unsigned",32,{BYTE}]]', BYTE),
    ("T10", f'["cast","low",8,["concat",["extract",31,8,{A}],["var","c",8]]]', '["var","c",8]'),
    ("T11", f'["cast","low",8,["cast","unsigned",32,["bin","==",{A},["int",{{k}},32]]]]', f'["cast","unsigned",8,["bin","==",{A},["int",{{k}},32]]]'),
    ("T12", f'["bin","==",["bin","-",{A},["int",{{k}},32]],["int",0,32]]', f'["bin","==",{A},["int",{{k}},32]]'),
    ("T13", f'["bin","^",{A},["int",4294967295,32]]', f'["un","~",{A}]'),
    ("T13", f'["bin","^",{A},["int",{{k}},32]]', f'["bin","^",{A},["int",{{k}},32]]'),
    ("T14", f'["cast","unsigned",32,["cast","low",8,{A}]]', f'["bin","&",{A},["int",255,32]]'),
]


def _sql(text: str) -> str:
    for name, value in (("{k}", "CAST(k AS VARCHAR)"), ("{n}", "CAST(4294967296 - k AS VARCHAR)"), ("{s}", "CAST(k + 7 AS VARCHAR)")):
        text = text.replace(name, f"' || {value} || '")
    return f"'{text}'"


RULES = "WITH p AS (SELECT p_partkey + 1 AS k FROM part) " + " UNION ALL ".join(f"SELECT k, {i} AS no, '{rule}' AS rule, {_sql(want)} AS tree FROM p" for i, (rule, _, want) in enumerate(CASES))


@query("t1_t14_rules", RULES)
def _(s, d):
    k = F.col("k").cast("string")

    def text(t: str):
        for name, value in (("{k}", k), ("{n}", (4294967296 - F.col("k")).cast("string")), ("{s}", (F.col("k") + 7).cast("string"))):
            if name in t:
                return F.concat(*[x for part in t.split(name) for x in (F.lit(part), value)][:-1])
        return F.lit(t)

    rows = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(rule).alias("rule"), text(t).alias("tree")) for i, (rule, t, _) in enumerate(CASES)])
    p = spread(E.table(s, d, "part").select((F.col("p_partkey") + 1).alias("k")), "k").select("k", F.explode(rows).alias("x")).select("k", "x.*")
    return p.withColumn("tree", X.normal_text(F.col("tree")))


@query("n15_evaluated", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey AS a, CAST(l_quantity AS BIGINT) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, (a * 77 + b) & 4294967295 AS v, xor(a, b) & 255 AS low, CASE WHEN a = b THEN a ELSE b END AS choice, a * 65536 + b AS joined FROM x""")
def _(s, d):
    t = E.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.create_map(F.lit("a"), F.col("l_partkey"), F.lit("b"), F.col("l_quantity").cast("long")).alias("env"))
    v = lambda tree: X.evaluated(F.lit(tree), F.col("env"))
    return t.select(
        "l_orderkey", "l_linenumber", v(f'["bin","+",["bin","*",{A},["int",77,32]],{C}]').alias("v"), v(f'["cast","low",8,["bin","^",{A},{C}]]').alias("low"),
        v(f'["ite",["bin","==",{A},{C}],{A},{C}]').alias("choice"), v('["concat",["var","a",32],["var","b",16]]').alias("joined"),
    )


# Written and read again


@query("s5_result_lines", f"""WITH {E.RESULT} SELECT DISTINCT fuzz, CASE WHEN fuzz = 'Fuzzy' THEN mean END AS mean, CASE WHEN fuzz = 'Fuzzy' THEN n_total END AS n_total, CASE WHEN fuzz = 'Fuzzy' THEN n_partial END AS n_partial, CASE WHEN fuzz = 'Fuzzy' THEN n_sub END AS n_sub, CASE WHEN fuzz = 'Fuzzy' THEN n_sup END AS n_sup,
  overlap, n, CASE WHEN overlap = 'Partial' THEN d END AS d, CAST(cluster AS VARCHAR) AS cluster FROM result WHERE fuzz IS NOT NULL""")
def _(s, d):
    r = res(s, d).where("fuzz is not null")
    n, both = F.col("n").cast("string"), F.format_string("(%d %d)", "n", "d")
    over = F.concat(F.lit("(Overlap"), F.col("overlap"), F.lit(" "), F.when(F.col("overlap") == "Partial", both).otherwise(n), F.lit(")"))
    counts = ("n_total", "n_partial", "n_sub", "n_sup")
    fuzz = F.when(F.col("fuzz") == "Fuzzy", F.concat(F.lit("(Fuzzy ("), F.col("mean").cast("string"), F.lit(" ("), F.concat_ws(" ", *[F.col(c).cast("string") for c in counts]), F.lit(")))"))).otherwise(F.col("fuzz"))
    lines = r.select(sexp.result_line(fuzz, over, F.col("cluster").cast("string"), F.lit("iso"), F.lit("-")).alias("value")).distinct()
    return sexp.parse_results(lines).select("fuzz", "mean", *counts, "overlap", "n", "d", "cluster")


@query("p3_parsed_subjects", f"WITH {E.SUBJECT} SELECT id, prim, compiler, version, olevel, symbol, addr FROM subject")
def _(s, d):
    t = E.subjects(s, d)
    parsed = P.parse_subject(P.subject_name())
    return t.select("id", *[c.alias(n) for n, c in parsed.items()]).select("id", "prim", "compiler", "version", "olevel", "symbol", "addr")


@query("s15_specs", "SELECT p_partkey AS id, '/bin/' || p_partkey AS path, 'f' || p_size || ',g' AS funcs FROM part")
def _(s, d):
    p = E.table(s, d, "part").select(F.col("p_partkey").alias("id"), R.parse_spec(F.concat(F.lit("/bin/"), "p_partkey", F.lit(",funcs=f"), "p_size", F.lit(":g"))).alias("x"))
    return p.select("id", "x.path", F.array_join(F.element_at("x.parameters", "funcs"), ",").alias("funcs"))


@query("f3_wanted_functions", "SELECT p_partkey AS start, p_name FROM part WHERE p_partkey IN (16, 17) OR p_name IN ('red widget', 'small ring')")
def _(s, d):
    p = E.table(s, d, "part").select(F.col("p_partkey").alias("start"), "p_name", F.array("p_name").alias("symbols"))
    return R.wanted_functions(p, ["0x10", "0x11", "red widget", "small ring"]).select("start", "p_name")


@query("f11_small_ranges", f"WITH {E.INTERVAL} SELECT base, lo, hi, abs(lo * 100000) < 16777216 AND abs(hi * 100000) < 16777216 AS small FROM access")
def _(s, d):
    return E.intervals(s, d).select("base", "lo", "hi", S.small_range(F.col("lo") * 100000, F.col("hi") * 100000).alias("small"))


INLINED = """o AS (SELECT l_suppkey AS origin, count(*) FILTER (WHERE l_returnflag = 'A') AS n_copies, count(*) FILTER (WHERE l_returnflag = 'R') AS n_expansions FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0)"""


@query("s16_s17_j22_inlined", f"WITH {INLINED} SELECT origin, n_copies, n_expansions, n_copies > 0 AS with_callees FROM o")
def _(s, d):
    t = E.table(s, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "copy").when(F.col("l_returnflag") == "R", "expansion").otherwise("other")
    dies = t.select(F.col("l_suppkey").alias("origin"), kind.alias("kind"), F.lit("f").alias("name"), F.col("l_orderkey").alias("lo"), F.col("l_partkey").alias("hi"))
    a, b = R.inlined(dies)
    both = a.withColumn("with_callees", F.lit(True)).unionByName(b.withColumn("with_callees", F.lit(False)))
    return both.select("origin", F.size("callees").cast("long").alias("n_copies"), F.size("expansions").cast("long").alias("n_expansions"), "with_callees")


def configuration(s, d) -> str:
    """A configuration in JSON, of the tables' few types, brands, regions, nations and priorities."""
    p = E.table(s, d, "part")
    version = F.struct(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("major"), (F.col("p_size") % 4).alias("minor"), (F.col("p_size") % 3).alias("patch"))
    versions = p.groupBy("p_type").agg(F.array_sort(F.collect_set(version)).alias("versions"))
    compilers = versions.agg(F.array_sort(F.collect_list(F.struct(F.col("p_type").alias("name"), "versions"))).alias("compilers"))
    nations = E.table(s, d, "nation").join(E.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("name")).agg(F.array_sort(F.collect_set("n_name")).alias("implementations"))
    primitives = nations.agg(F.array_sort(F.collect_list(F.struct("name", "implementations"))).alias("primitives"))
    space = E.table(s, d, "orders").agg(F.struct(F.struct(F.array_sort(F.collect_set(F.substring("o_orderpriority", 1, 1))).alias("space"), F.lit("O@").alias("descr_fmt")).alias("olevel")).alias("available_parameters"))
    return compilers.join(primitives).join(space).select(F.to_json(F.struct("*"))).first()[0]  # one row each


@query("b7_s8_sweep", r"""SELECT DISTINCT p_type AS compiler, regexp_extract(p_brand, '(\d+)', 1) || '.' || minor || '.0' AS version, r_name AS prim, n_name AS implementation, 'O' || substr(o_orderpriority, 1, 1) AS descr
FROM (SELECT DISTINCT p_type, p_brand, p_size % 4 AS minor FROM part WHERE p_size % 3 = 0), (SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey), (SELECT DISTINCT o_orderpriority FROM orders)""")
def _(s, d):
    return R.sweep(R.config_tables(s, configuration(s, d)))


@query("s13_paths_by_name", "SELECT 'p' || p_size AS name, '/bin/p' || p_size AS path FROM part GROUP BY p_size")
def _(s, d):
    return R.paths_by_name(E.table(s, d, "part").select(F.concat(F.lit("/bin/p"), "p_size").alias("path")))


@query("f1_selected_versions", f"WITH {E.SUBJECT} SELECT id FROM subject WHERE compiler = 'gcc' AND version LIKE '1%' AND prim IN ('promo', 'economy')")
def _(s, d):
    return B.selected(P.matching_versions(E.subjects(s, d), "gcc", "1"), "prim", ["promo", "economy"]).select("id")


@query("a5_by_major_version", f"""WITH {E.RESULT}, m AS (SELECT CAST(symbol AS VARCHAR) || '.' || (cust % 2) AS major, cust, bool_or(identical OR (completed AND fuzz = 'ExactOnly' AND overlap = 'Total')) AS matched FROM result GROUP BY ALL) SELECT major, count(*) AS n_subjects, count(*) FILTER (WHERE coalesce(matched, false)) AS n_matched FROM m GROUP BY major""")
def _(s, d):
    from ..operators.classify import is_exact

    r = res(s, d).withColumn("major", F.concat_ws(".", F.col("symbol").cast("string"), (F.col("cust") % 2).cast("string")))
    m = r.groupBy("major", "cust").agg(F.bool_or(F.col("identical") | (F.col("completed") & is_exact())).alias("matched"))
    return m.groupBy("major").agg(F.count("*").alias("n_subjects"), F.count_if(F.coalesce("matched", F.lit(False))).alias("n_matched"))


@query("m12_pair_verdicts", f"""WITH {E.STMT}, t AS (SELECT func, pos, op FROM stmt), x AS (SELECT coalesce(a.func, b.func - 1) AS func, coalesce(a.pos, b.pos) AS pos, a.op IS NOT DISTINCT FROM b.op AS same FROM (SELECT * FROM t WHERE func % 2 = 0) a FULL JOIN (SELECT * FROM t WHERE func % 2 = 1) b ON b.func = a.func + 1 AND b.pos = a.pos)
SELECT func, CASE WHEN bool_and(same) THEN 'identical' ELSE 'differ at ' || min(pos) FILTER (WHERE NOT same) END AS verdict FROM x GROUP BY func""")
def _(s, d):
    from ..operators.straightline import pair_verdicts

    t = E.statements(s, d).select("func", "pos", "op")
    return pair_verdicts(t.where("func % 2 = 0"), t.where("func % 2 = 1").withColumn("func", F.col("func") - 1), ["op"])


MAPS = "m AS (SELECT user_id, event_type AS k, count(*) AS n, count(*) FILTER (WHERE value > 50) AS big FROM events GROUP BY ALL)"


@query("u4_maps", f"WITH {MAPS}, x AS (SELECT user_id, k, CASE WHEN k < 'error' THEN n WHEN k < 'purchase' THEN n + big ELSE big END AS v FROM m WHERE k < 'purchase' OR k >= 'error') SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS entries FROM x WHERE v > 1 GROUP BY user_id")
def _(s, d):
    m = E.table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("big"))
    side = lambda value, keep: F.map_from_entries(F.array_compact(F.collect_list(F.when(keep, F.struct("event_type", value)))))
    g = m.groupBy("user_id").agg(side("n", F.col("event_type") < "purchase").alias("a"), side("big", F.col("event_type") >= "error").alias("b"))
    both = S.filtered_map(S.merged_maps(F.col("a"), F.col("b"), lambda x, y: x + y), lambda k, v: v > 1)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(both)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return g.select("user_id", text.alias("entries")).where("entries != ''")


@query("u20_printed", "SELECT user_id, '[' || string_agg(CAST(event_id AS VARCHAR), '; ' ORDER BY event_id) || ']' AS ids, right('00000000' || bin(user_id % 256), 8) AS bits FROM events GROUP BY user_id")
def _(s, d):
    g = E.table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return g.select("user_id", S.listed(F.col("ids")).alias("ids"), S.bit_text(F.col("user_id") % 256, 8).alias("bits"))


@query("n13_random_bits", "SELECT 2000 * (SELECT count(*) FROM part) // (SELECT count(*) FROM part) AS thousandth, true AS in_range, true AS again FROM region LIMIT 1")
def _(s, d):
    p = E.table(s, d, "part").select(S.random_bits(F.col("p_partkey"), 12, 7).alias("a"), S.random_bits(F.col("p_partkey"), 12, 7).alias("b"))
    return p.agg(F.lit(2000).cast("long").alias("thousandth"), F.bool_and(F.col("a").between(0, 4095)).alias("in_range"), F.bool_and(F.col("a") == F.col("b")).alias("again"))
