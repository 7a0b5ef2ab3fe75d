"""Queries over programs with branches, loops and calls, made of users' events, with their SQL where SQL can tell the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import passes as PS
from ..operators import programs as P
from . import encode as E
from .registry import query

EV = """ev AS (SELECT user_id AS func, event_id AS id, event_type AS kind, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def events(s, d):
    """func, id, kind, value, k, n: a user's events in order."""
    w = Window.partitionBy("user_id")
    e = E.table(s, d, "events")
    return e.select(F.col("user_id").alias("func"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value", F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("k"), F.count("*").over(w).alias("n"))


def programs(s, d):
    """Statements (func, pos, kind, avar, tree, target, other): a user is a function, each event a statement behind a label.

    signup adds, view loads, purchase stores, click branches two labels ahead (from
    value 80 on back to its own, a loop), error calls. One function in seventeen
    ends in an indirect jump.
    """
    e = events(s, d)
    var = lambda n: F.concat(F.lit('["var","v'), (n % 6).cast("string"), F.lit('",32]'))
    num = lambda n: F.concat(F.lit('["int",'), n.cast("string"), F.lit(",32]"))
    old, place = F.floor(F.col("id") / 6), num(F.col("id") % 4 * 4)
    frame = F.concat(F.lit('["bin","+",["var","esp",32],'), place, F.lit("]"))
    tree = (
        F.when(F.col("kind") == "view", F.concat(F.lit('["load",["var","mem",0],'), F.when(F.col("id") % 2 == 0, frame).otherwise(F.concat(F.lit('["bin","+",'), var(old), F.lit(","), place, F.lit("]"))), F.lit(",32]")))
        .when(F.col("kind") == "purchase", F.concat(F.lit('["store",["var","mem",0],'), frame, F.lit(","), var(F.col("id")), F.lit(",32]")))
        .when(F.col("kind") == "click", F.concat(F.lit('["bin","=="'), F.lit(","), var(F.col("id")), F.lit(","), num(F.col("id") % 3), F.lit("]")))
        .when(F.col("kind") == "signup", F.concat(F.lit('["bin","+",'), var(old), F.lit(","), num(F.col("id") % 16), F.lit("]")))
    )
    label = lambda k: F.when(k > F.col("n"), "end").otherwise(F.concat(F.lit("L"), k.cast("string")))
    k = F.col("k")
    kind = F.when(F.col("kind") == "click", "cjmp").when(F.col("kind") == "error", "call").otherwise("move")
    avar = F.when(F.col("kind") == "purchase", "mem").when(F.col("kind") == "error", F.when(F.col("id") % 37 == 0, "abort").otherwise(F.concat(F.lit("f"), (F.col("id") % 50).cast("string")))).when(F.col("kind") != "click", F.concat(F.lit("v"), (F.col("id") % 6).cast("string")))
    ahead = F.when(F.col("kind") == "click", F.when(F.col("value") >= 80, label(k)).otherwise(label(k + 2)))
    none = F.lit(None).cast("string")
    row = lambda pos, *x: F.struct(pos.alias("pos"), *[c.alias(n) for c, n in zip(x, ("kind", "avar", "tree", "target", "other"))])
    body = e.select("func", F.explode(F.array(row(2 * k, F.lit("label"), F.concat(F.lit("L"), k.cast("string")), none, none, none), row(2 * k + 1, kind, avar, tree, ahead, F.when(F.col("kind") == "click", label(k + 1))))).alias("x")).select("func", "x.*")
    last = e.where("k = n").select("func", F.explode(F.array(row(2 * k + 2, F.lit("label"), F.lit("end"), none, none, none), row(2 * k + 3, F.lit("move"), F.lit("eax"), F.lit('["var","v0",32]'), none, none), row(2 * k + 4, F.when(F.col("func") % 17 == 0, "jmp").otherwise("halt"), none, none, none, none))).alias("x")).select("func", "x.*")
    return body.unionByName(last)


@query("passes_pipeline")
def _(s, d):
    return PS.normalized(programs(s, d)).groupBy("func").agg(F.count("block").alias("n_left"), F.count_distinct("block").alias("n_blocks"), F.max("reason").alias("reason"))


@query("k8_k9_pass_snapshots")
def _(s, d):
    from ..sources.sinks import pass_snapshots, snapshots

    return snapshots(pass_snapshots(programs(s, d))).groupBy("no", "name").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"), F.count_if("cfg_changed").alias("n_cfg_changed"))


@query("pass3_confusing_functions", f"WITH {EV} SELECT DISTINCT func, 'CollectCalls: indirect jump' AS reason FROM ev WHERE func % 17 = 0")
def _(s, d):
    return PS.normalized(programs(s, d), [("CollectCalls", PS.collect_calls)]).where("reason is not null").select("func", "reason")


@query("pass3_pass15_counts", f"WITH {EV} SELECT func, count(*) + 1 AS n_labels, count(*) FILTER (WHERE kind = 'error') AS n_calls, 1 AS n_halts FROM ev WHERE func % 17 > 0 GROUP BY func")
def _(s, d):
    from ..operators.memory_passes import address_map

    def run(f):
        PS.collect_calls(f)
        address_map(f)
        return [(len(f.info["blocks"]), len(f.info["calls"]), f.info["halts"])]

    return P.per_function(programs(s, d), run, "n_labels long, n_calls long, n_halts long")


@query("pass4_pass5_calls_replaced", f"WITH {EV} SELECT func, count(*) FILTER (WHERE kind = 'error') AS n_esp, 0 AS n_halts FROM ev WHERE func % 17 > 0 GROUP BY func")
def _(s, d):
    out = PS.normalized(programs(s, d), [("CollectCalls", PS.collect_calls), ("ReplaceCalls", PS.replace_calls), ("RemoveHalts", PS.remove_halts)]).where("reason is null")
    return out.groupBy("func").agg(F.count_if((F.col("kind") == "move") & (F.col("avar") == "esp")).alias("n_esp"), F.count_if(F.col("kind") == "halt").alias("n_halts"))


@query("g29_leaders", f"""WITH {EV}, t AS (SELECT func, k FROM ev UNION ALL SELECT func, n + 1 FROM ev WHERE k = n) SELECT func, count(*) AS n_blocks FROM t GROUP BY func""")
def _(s, d):
    return P.per_function(programs(s, d), lambda f: [(len(set(f.blocks) - PS.SPECIAL),)], "n_blocks long")


@query("g30_layout", f"WITH {EV} SELECT func, count(*) FILTER (WHERE kind = 'error') AS n_calls, true AS same FROM ev WHERE func % 17 > 0 GROUP BY func")
def _(s, d):
    from ..operators.graphs import signature
    from ..operators.memory_passes import layout

    def shape(f):
        """The graph without blocks that only pass on."""
        for p in (PS.prune, PS.coalesce, PS.drop_nops, PS.coalesce):
            p(f)
        return signature({v: [(-1 if e[2] is None else int(e[2]), e[1]) for e in f.out(v)] for v in f.blocks}, PS.ENTRY)

    def run(f):
        g = PS.from_statements(layout(f))
        n = sum(s[0] == "call" for *_, s in g.statements())
        return [(n, shape(f) == shape(g))]

    return P.per_function(programs(s, d).where("func % 17 > 0"), run, "n_calls long, same boolean")


@query("pass10_used_bits", f"WITH {EV}, u AS (SELECT DISTINCT func, 'v' || (id % 6) AS var FROM ev WHERE kind IN ('click', 'purchase') UNION SELECT func, 'v' || ((id // 6) % 6) FROM ev WHERE kind = 'signup' OR (kind = 'view' AND id % 2 = 1) UNION SELECT func, 'v0' FROM ev UNION SELECT func, 'esp' FROM ev WHERE kind = 'purchase' OR (kind = 'view' AND id % 2 = 0)) SELECT func, var, 0 AS low, 32 AS bits FROM u")
def _(s, d):
    return P.used_bits_table(programs(s, d))


@query("pass23_named_arrays", f"WITH {EV} SELECT DISTINCT func, 'esp[' || (id % 4 * 4) || ':' || (id % 4 * 4 + 3) || ']' AS array FROM ev WHERE func % 17 > 0 AND (kind = 'purchase' OR (kind = 'view' AND id % 2 = 0))")
def _(s, d):
    # Straight-line: without branches and calls all accesses to the frame have one base.
    t = programs(s, d).where("func % 17 > 0 and kind not in ('cjmp', 'call')").where("avar is null or avar != 'esp'")
    return P.named_arrays(t).where(F.col("array").startswith("esp["))


@query("g21_address_regions")
def _(s, d):
    return P.address_regions(programs(s, d)).groupBy("base").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query("g25_pointers")
def _(s, d):
    return P.pointer_variables(programs(s, d))


@query("g26_value_sets")
def _(s, d):
    return P.value_sets(programs(s, d))


@query("u9_load_regions")
def _(s, d):
    return P.load_regions(programs(s, d))


@query("u2_branch_flags")
def _(s, d):
    return P.branch_flags(programs(s, d))


@query("pass27_exit_kinds")
def _(s, d):
    return P.exit_kinds(programs(s, d))


@query("g28_post_orders")
def _(s, d):
    return P.post_orders(programs(s, d))


STRIDED = "x AS (SELECT l_orderkey, l_linenumber, l_linenumber AS st, l_partkey AS lo, l_partkey + l_linenumber * CAST(l_quantity AS BIGINT) AS hi, l_suppkey % 3 AS st2, l_suppkey AS lo2, l_suppkey + (l_suppkey % 3) * 5 AS hi2 FROM lineitem)"


def strided(s, d):
    t = E.table(s, d, "lineitem")
    q = F.col("l_quantity").cast("long")
    box = lambda st, lo, n: F.struct(st.cast("long").alias("stride"), lo.cast("long").alias("lo"), (lo + st * n).cast("long").alias("hi"))
    return t.select("l_orderkey", "l_linenumber", box(F.col("l_linenumber"), F.col("l_partkey"), q).alias("a"), box(F.col("l_suppkey") % 3, F.col("l_suppkey"), F.lit(5)).alias("b"))


@query("n7_strided_add", f"WITH {STRIDED} SELECT l_orderkey, l_linenumber, CASE WHEN lo + lo2 = hi + hi2 THEN 0 ELSE gcd(st, st2) END AS stride, lo + lo2 AS lo, hi + hi2 AS hi FROM x")
def _(s, d):
    return strided(s, d).withColumn("x", P.strided_column("+", F.col("a"), F.col("b"))).select("l_orderkey", "l_linenumber", "x.*")


@query("n7_strided_sub", f"WITH {STRIDED} SELECT l_orderkey, l_linenumber, CASE WHEN lo - hi2 = hi - lo2 THEN 0 ELSE gcd(st, st2) END AS stride, lo - hi2 AS lo, hi - lo2 AS hi FROM x")
def _(s, d):
    return strided(s, d).withColumn("x", P.strided_column("-", F.col("a"), F.col("b"))).select("l_orderkey", "l_linenumber", "x.*")


@query("n7_strided_union", f"WITH {STRIDED}, u AS (SELECT *, gcd(gcd(st, st2), abs(lo - lo2)) AS g, least(lo, lo2) AS l, greatest(hi, hi2) AS h FROM x) SELECT l_orderkey, l_linenumber, CASE WHEN l = h THEN 0 ELSE g END AS stride, l AS lo, h AS hi FROM u")
def _(s, d):
    return strided(s, d).withColumn("x", P.strided_column("union", F.col("a"), F.col("b"))).select("l_orderkey", "l_linenumber", "x.*")


@query("n7_strided_neg", f"WITH {STRIDED} SELECT l_orderkey, l_linenumber, CASE WHEN lo = hi THEN 0 ELSE st END AS stride, -hi AS lo, -lo AS hi FROM x")
def _(s, d):
    return strided(s, d).withColumn("x", P.strided_column("neg", F.col("a"), F.col("b"))).select("l_orderkey", "l_linenumber", "x.*")


#: Each operation on the intervals of a line, narrowed to what the operation is exact for: quantities, and a constant of the supplier.
OPERATIONS = ("not", "*", "&", "|", "^", "<<", ">>", "s>>", "%", "==")

WIDE = "lo < -2147483648 OR hi > 2147483647"
ONES = "CAST(pow(2, length(bin(greatest(q, c)))) AS BIGINT) - 1"


@query("n7_strided_operations", f"""WITH y AS (SELECT l_orderkey, l_linenumber, l_linenumber AS st, CAST(l_quantity AS BIGINT) AS p, CAST(l_quantity AS BIGINT) + l_linenumber * (l_partkey % 5) AS q, l_suppkey % 40 AS c FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, 'not' AS op, st, -q - 1 AS lo, -p - 1 AS hi, 32 AS w FROM y UNION ALL SELECT l_orderkey, l_linenumber, '*', st * c, p * c, q * c, 32 FROM y
  UNION ALL SELECT l_orderkey, l_linenumber, '&', 1, CASE WHEN p = q THEN p & c ELSE 0 END, CASE WHEN p = q THEN p & c ELSE least(q, c) END, 32 FROM y
  UNION ALL SELECT l_orderkey, l_linenumber, '|', 1, CASE WHEN p = q THEN p | c ELSE greatest(p, c) END, CASE WHEN p = q THEN p | c ELSE {ONES} END, 32 FROM y
  UNION ALL SELECT l_orderkey, l_linenumber, '^', 1, CASE WHEN p = q THEN xor(p, c) ELSE 0 END, CASE WHEN p = q THEN xor(p, c) ELSE {ONES} END, 32 FROM y
  UNION ALL SELECT l_orderkey, l_linenumber, '<<', CASE WHEN c < 32 THEN CAST(st * pow(2, c) AS BIGINT) ELSE 1 END, CASE WHEN c < 32 THEN CAST(p * pow(2, c) AS BIGINT) ELSE -2147483648 END, CASE WHEN c < 32 THEN CAST(q * pow(2, c) AS BIGINT) ELSE 2147483647 END, 32 FROM y
  UNION ALL SELECT l_orderkey, l_linenumber, unnest(['>>', 's>>']), 1, CASE WHEN c < 32 THEN CAST(floor(p / pow(2, c)) AS BIGINT) ELSE -2147483648 END, CASE WHEN c < 32 THEN CAST(floor(q / pow(2, c)) AS BIGINT) ELSE 2147483647 END, 32 FROM y
  UNION ALL SELECT l_orderkey, l_linenumber, '%', CASE WHEN c > q THEN st ELSE 1 END, CASE WHEN c > q THEN p WHEN c > 0 THEN 0 ELSE -2147483648 END, CASE WHEN c > q THEN q WHEN c > 0 THEN c - 1 ELSE 2147483647 END, 32 FROM y
  UNION ALL SELECT l_orderkey, l_linenumber, '==', 1, CASE WHEN p = q AND p = c THEN -1 WHEN p = q OR c < p OR c > q OR (st > 1 AND (c - p) % st <> 0) THEN 0 ELSE -1 END, CASE WHEN p = q AND p = c THEN -1 ELSE 0 END, 1 FROM y),
t AS (SELECT *, {WIDE} AS lost FROM r)
SELECT l_orderkey, l_linenumber, op, CAST(CASE WHEN lost THEN 1 WHEN lo = hi THEN 0 ELSE st END AS BIGINT) AS stride, CAST(CASE WHEN lost THEN -2147483648 ELSE lo END AS BIGINT) AS lo, CAST(CASE WHEN lost THEN 2147483647 ELSE hi END AS BIGINT) AS hi FROM t""")
def _(s, d):
    t = E.table(s, d, "lineitem")
    q, st, c = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), (F.col("l_suppkey") % 40).cast("long")
    high = q + st * (F.col("l_partkey") % 5)
    box = lambda *x: F.struct(*[v.cast("long").alias(n) for v, n in zip(x, ("stride", "lo", "hi"))])
    t = t.select("l_orderkey", "l_linenumber", box(F.when(high == q, 0).otherwise(st), q, high).alias("a"), box(F.lit(0), c, c).alias("b"))
    rows = [F.struct(F.lit(op).alias("op"), P.strided_column(op, F.col("a"), F.col("b")).alias("x")) for op in OPERATIONS]
    return t.select("l_orderkey", "l_linenumber", F.inline(F.array(*rows))).select("l_orderkey", "l_linenumber", "op", "x.*")


# Calls


@query("g15_j14_call_graph", f"WITH {EV}, c AS (SELECT func, CASE WHEN id % 37 = 0 THEN 'abort' ELSE 'f' || (id % 50) END AS target FROM ev WHERE kind = 'error'), fs AS (SELECT DISTINCT func, 'f' || func AS symbol FROM ev WHERE func % 3 > 0) SELECT c.func AS caller, fs.func AS callee, count(*) AS n FROM c LEFT JOIN fs ON fs.symbol = c.target GROUP BY ALL")
def _(s, d):
    return P.call_graph(*calls(s, d))


def calls(s, d):
    t = programs(s, d).where("kind = 'call'").select("func", F.col("avar").alias("target"))
    names = events(s, d).select("func").distinct().where("func % 3 > 0").withColumn("symbol", F.concat(F.lit("f"), F.col("func").cast("string")))
    return t, names


@query("u12_g27_kill_summaries", f"""WITH RECURSIVE {EV}, c AS (SELECT DISTINCT ev.func AS caller, fs.func AS callee FROM ev LEFT JOIN (SELECT DISTINCT func FROM ev WHERE func % 3 > 0) fs ON 'f' || fs.func = CASE WHEN id % 37 = 0 THEN 'abort' ELSE 'f' || (id % 50) END WHERE kind = 'error'),
own AS (SELECT DISTINCT func, 'reg:v' || (id % 6) AS kill FROM ev WHERE kind = 'signup' UNION SELECT func, 'stack:' || (id % 4) FROM ev WHERE kind = 'purchase' UNION SELECT caller, unnest(['all_regs', 'all_memory']) FROM c WHERE callee IS NULL),
k AS (SELECT * FROM own UNION SELECT c.caller, k.kill FROM k JOIN c ON c.callee = k.func), fl AS (SELECT func, bool_or(kill = 'all_regs') AS r, bool_or(kill = 'all_memory') AS m FROM k GROUP BY func)
SELECT k.func, k.kill FROM k JOIN fl USING (func) WHERE kill IN ('all_regs', 'all_memory') OR (kill LIKE 'reg:%' AND NOT r) OR (kill NOT LIKE 'reg:%' AND NOT m)""")
def _(s, d):
    e = events(s, d)
    graph = P.call_graph(*calls(s, d)).select("caller", "callee")
    own = e.where("kind = 'signup'").select("func", F.concat(F.lit("reg:v"), (F.col("id") % 6).cast("string")).alias("kill")).unionByName(e.where("kind = 'purchase'").select("func", F.concat(F.lit("stack:"), (F.col("id") % 4).cast("string")).alias("kill")))
    return P.kill_summaries(graph, own)


@query("pass12_undefined_after_calls", f"WITH {EV}, l AS (SELECT func, max(k) AS k FROM ev WHERE kind = 'view' GROUP BY func) SELECT func, k AS pos, unnest(['eax', 'ecx', 'edx']) AS var FROM ev WHERE kind = 'error' UNION ALL SELECT ev.func, ev.k, 'mem' FROM ev JOIN l ON l.func = ev.func AND ev.k < l.k WHERE kind = 'error'")
def _(s, d):
    e = events(s, d).select("func", F.col("k").alias("pos"), "kind")
    return P.undefined_after_calls(e.where("kind = 'error'").select("func", "pos"), e.where("kind = 'view'").select("func", "pos"))


@query("u11_call_heights", f"WITH {EV}, st AS (SELECT func, k, CASE WHEN value < 2 THEN NULL WHEN kind = 'purchase' THEN -4 ELSE 4 END AS step FROM ev WHERE kind IN ('purchase', 'view')) SELECT ev.func, ev.k AS pos, CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.func = ev.func AND st.k < ev.k AND step IS NULL) THEN NULL ELSE coalesce((SELECT sum(step) FROM st WHERE st.func = ev.func AND st.k < ev.k), 0) END AS height FROM ev WHERE kind = 'error'")
def _(s, d):
    e = events(s, d).select("func", F.col("k").alias("pos"), "kind", "value")
    steps = e.where("kind in ('purchase', 'view')").select("func", "pos", F.when(F.col("value") >= 2, F.when(F.col("kind") == "purchase", -4).otherwise(4)).alias("step"))
    return P.with_heights(e.where("kind = 'error'").select("func", "pos"), steps)


@query("u10_exit_heights", f"WITH {EV}, h AS (SELECT func, CASE WHEN value < 5 THEN NULL ELSE (func % 3) * 4 - 4 + CASE WHEN value > 95 THEN 8 ELSE 0 END END AS height FROM ev WHERE kind = 'click'), g AS (SELECT func, min(height) AS lo, max(height) AS hi, count(*) = count(height) AS alls FROM h GROUP BY func) SELECT func, CASE WHEN alls AND lo = hi AND hi <= 4 THEN hi END AS height, coalesce(alls AND lo = hi AND hi <= 4, false) AS well_behaved FROM g")
def _(s, d):
    e = events(s, d).where("kind = 'click'")
    return P.exit_heights(e.select("func", F.when(F.col("value") >= 5, (F.col("func") % 3) * 4 - 4 + F.when(F.col("value") > 95, 8).otherwise(0)).alias("height")))


# Statements


@query("u14_variable_ids", f"WITH {E.STMT} SELECT func, pos, avar, dense_rank() OVER (PARTITION BY func ORDER BY avar) AS id FROM stmt")
def _(s, d):
    return P.numbered_variables(E.statements(s, d), "avar").select("func", "pos", "avar", "id")


@query("u15_transferred_ids", f"""WITH {E.STMT}, a AS (SELECT func, row_number() OVER (PARTITION BY func ORDER BY pos) - 1 AS ordinal FROM stmt WHERE op <> 'add'), b AS (SELECT func, row_number() OVER (PARTITION BY func ORDER BY pos) - 1 AS ordinal, avar AS id FROM stmt WHERE op <> 'add' AND NOT (func % 5 = 0 AND b > 45)),
n AS (SELECT func, x.c <> y.c OR x.c IS NULL OR y.c IS NULL AS bad FROM (SELECT func, count(*) AS c FROM a GROUP BY func) x FULL JOIN (SELECT func, count(*) AS c FROM b GROUP BY func) y USING (func))
SELECT a.func, a.ordinal, b.id, NULL AS reason FROM a JOIN b ON a.func = b.func AND a.ordinal = b.ordinal JOIN n ON n.func = a.func WHERE NOT bad UNION ALL SELECT func, NULL, NULL, 'memory operations differ' FROM n WHERE bad""")
def _(s, d):
    t = E.statements(s, d)
    ordinals = lambda x: P.memory_ordinals(x, F.col("op") != "add").where("ordinal is not null")
    return P.transferred(ordinals(t), ordinals(t.where("not (op != 'add' and func % 5 = 0 and b > 45)")).withColumn("id", F.col("avar")))


@query("p16_block_bounds", f"""WITH {E.STMT}, x AS (SELECT func, pos // 3 AS block, pos, CASE WHEN op = 'load' THEN a * 16 + b END AS addr FROM stmt) SELECT func, block, arg_min(addr, pos) FILTER (WHERE addr IS NOT NULL) AS first_addr, arg_max(addr, pos) FILTER (WHERE addr IS NOT NULL) AS last_addr FROM x GROUP BY ALL""")
def _(s, d):
    return P.block_bounds(addressed(s, d))


def addressed(s, d):
    return E.statements(s, d).select("func", F.floor(F.col("pos") / 3).alias("block"), "pos", F.when(F.col("op") == "load", F.col("a") * 16 + F.col("b")).alias("addr"))


@query("j15_calls_at_ends", f"""WITH {E.STMT}, x AS (SELECT func, pos // 3 AS block, pos, CASE WHEN op = 'load' THEN a * 16 + b END AS addr FROM stmt), bd AS (SELECT func, block, arg_max(addr, pos) FILTER (WHERE addr IS NOT NULL) AS last_addr FROM x GROUP BY ALL),
st AS (SELECT DISTINCT func, addr AS site, addr % 11 AS callee FROM x WHERE addr % 2 = 0) SELECT bd.func, block, callee FROM bd JOIN st ON st.func = bd.func AND st.site = bd.last_addr""")
def _(s, d):
    x = addressed(s, d)
    sites = x.where("addr % 2 = 0").select("func", F.col("addr").alias("site"), (F.col("addr") % 11).alias("callee")).distinct()
    return P.calls_at_ends(P.block_bounds(x), sites)


@query("w10_split_after_calls", f"""WITH {EV}, a AS (SELECT func, k, kind, last_value(CASE WHEN k % 3 = 1 THEN id END IGNORE NULLS) OVER (PARTITION BY func ORDER BY k) AS addr FROM ev),
c AS (SELECT *, max(CASE WHEN kind = 'error' THEN k END) OVER (PARTITION BY func ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS call FROM a), m AS (SELECT c.*, coalesce(c.addr <> x.addr, false) AS moved FROM c LEFT JOIN a x ON x.func = c.func AND x.k = c.call),
f AS (SELECT *, moved AND NOT coalesce(lag(moved) OVER w AND lag(call) OVER w IS NOT DISTINCT FROM call, false) AS first FROM m WINDOW w AS (PARTITION BY func ORDER BY k))
SELECT func, k AS pos, CAST(sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY func ORDER BY k) AS BIGINT) AS block FROM f""")
def _(s, d):
    e = events(s, d).select("func", F.col("k").alias("pos"), "kind", F.when(F.col("k") % 3 == 1, F.col("id")).alias("addr"))
    return P.split_after_calls(e, F.col("kind") == "error").select("func", "pos", "block")


@query("x2_aliases", f"WITH {E.INTERVAL}, o AS (SELECT base, min(lo) AS lo, min(hi) AS hi FROM access GROUP BY base) SELECT a.base, a.lo, a.hi, a.lo <= o.hi AND o.lo <= a.hi AS meets FROM access a JOIN o USING (base)")
def _(s, d):
    a = E.intervals(s, d).select("base", "lo", "hi")
    o = a.groupBy("base").agg(F.min("lo").alias("olo"), F.min("hi").alias("ohi")).withColumn("other", F.col("base"))
    return a.join(o, "base").select("base", "lo", "hi", P.aliases(F.col("base"), F.col("lo"), F.col("hi"), F.col("other"), F.col("olo"), F.col("ohi")).alias("meets"))


@query("u8_frame_code", f"WITH {EV} SELECT func, id, CASE WHEN k <= 3 AND kind IN ('view', 'click') THEN 'prologue' WHEN kind = 'error' THEN 'epilogue' END AS code FROM ev")
def _(s, d):
    asm = F.when(F.col("kind") == "view", "push %ebp").when(F.col("kind") == "click", "mov %esp, %ebp").when(F.col("kind") == "error", "ret").otherwise("nop")
    return events(s, d).select("func", "id", P.frame_code(asm, F.col("k")).alias("code"))


@query("u21_contexts", "SELECT addr, string_agg(x, '; ' ORDER BY x) AS contexts FROM (SELECT DISTINCT user_id AS addr, event_type || '=' || CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) AS x FROM events) GROUP BY addr")
def _(s, d):
    return P.contexts(E.table(s, d, "events").select(F.col("user_id").alias("addr"), F.col("event_type").alias("name"), (F.floor("value") % 10).cast("string").alias("value")))


@query("f9_position_calls", f"WITH {EV} SELECT func, id, kind = 'error' AND id % 3 = 0 AS getpc FROM ev")
def _(s, d):
    from ..functions.scalars import is_position_call

    asm = F.when(F.col("kind") == "error", F.when(F.col("id") % 3 == 0, "call $+5").otherwise("call foo")).otherwise("nop")
    return events(s, d).select("func", "id", is_position_call(asm).alias("getpc"))
