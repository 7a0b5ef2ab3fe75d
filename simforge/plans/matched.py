"""Queries that match functions with changed copies of themselves, refine correspondences, and run dataflow and path bounds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correspondences as C
from ..operators import graphs as G
from ..operators import lattices as L
from ..operators import matching as M
from ..operators import measures as ME
from ..operators import programs as P
from ..operators import reduction as R
from ..operators.tables import settled
from . import encode as E
from .programs import EV, events, programs
from .registry import query

# Functions and changed copies: a user's events in order are blocks, each of which takes from one of the three before it.
# What is changed in the copy goes by the user's number: nothing, a block more, an output more, an output less, another
# operation in the first block, another input in the last, another operation in the last.

CHANGES = 7


def copies(s, d):
    """(blocks, edges) of every user's function on the left and its copy on the right, as match_pairs takes them."""
    e = events(s, d).select("func", "id", "kind", "value", "k", "n", (F.col("func") % CHANGES).alias("change"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    num = lambda n, w=32: text('["int",', n, f",{w}]")
    from_k = F.col("k") - 1 - F.col("id") % 3
    entry = lambda k: F.when(k == 1, -4).otherwise(k).cast("int")

    def side(name: str):
        right = name == "right"
        own, free, const = ("y", "w", "e") if right else ("x", "v", "c")
        first, last = (F.col("k") == 1) & right, (F.col("k") == F.col("n")) & right
        named = lambda at: F.when(at > 0, text(f'["var","{own}', at, '",32]')).otherwise(text(f'["var","{free}', F.abs(at), '",32]'))
        source = F.when(last & (F.col("change") == 5), F.when(from_k == F.col("k") - 1, named(F.col("k") - 2)).otherwise(named(F.col("k") - 1))).otherwise(named(from_k))
        both = lambda op, n: text(f'["bin","{op}",', *((num(n), ",", source) if right else (source, ",", num(n))), "]")
        load = text('["load",["var","mem",0],', both("+", F.col("id") % 4 * 4), ",32]")
        tree = F.when(F.col("kind") == "signup", both("+", F.col("id") % 16)).when(F.col("kind") == "view", load).when(F.col("kind") == "purchase", both("*", F.col("id") % 7)).when(F.col("kind") == "click", both("==", F.col("id") % 3)).otherwise(both("^", F.col("id") % 5))
        changed = (first & (F.col("change") == 4)) | (last & (F.col("change") == 6))
        tree = F.when(changed, text('["un","-",', source, "]")).otherwise(tree)
        out = lambda when, n, t: F.when(when, F.struct(n.alias("output"), t.alias("tree")))
        yes = F.lit(True)
        outs = F.array_compact(F.array(
            out(~(last & (F.col("change") == 3)), text(own, F.col("k")), tree),
            out(F.col("kind").isin("purchase", "error"), text(const, F.col("k")), num(F.col("id") % 4)),
            out(F.col("kind") == "error", text(const, F.col("k"), "b"), num(F.col("id") % 4)),
            out((F.col("k") == 1) & yes, F.lit(f"{const}p"), text(f'["bin","-",["var","{free}9",32],', num(F.lit(77)), "]")),
            out(last & (F.col("change") == 2), F.lit("more"), text(f'["bin","-",["var","{free}8",32],', num(F.lit(3)), "]")),
        ))
        blocks = e.select(F.col("func").alias("cluster"), F.lit(name).alias("side"), entry(F.col("k")).alias("block"), F.explode_outer(outs).alias("o")).select("cluster", "side", "block", "o.output", "o.tree")
        click = F.col("kind") == "click"
        to = F.when(F.col("value") >= 80, F.col("k")).otherwise(F.col("k") + 2)
        step = lambda when, d, label: F.when(when & (d <= F.col("n")), F.struct(entry(F.col("k")).alias("src"), entry(d).alias("dst"), label.cast("boolean").alias("label")))
        steps = F.array_compact(F.array(step(yes, F.col("k") + 1, F.when(click, False)), step(click, to, F.lit(True))))
        edges = e.select(F.col("func").alias("cluster"), F.lit(name).alias("side"), F.inline(steps))
        if right:
            extra = e.where("k = n and change = 1")
            blocks = blocks.unionByName(extra.select(F.col("func").alias("cluster"), F.lit(name).alias("side"), (F.col("n") + 1).cast("int").alias("block"), F.lit("last").alias("output"), num(F.lit(5)).alias("tree")))
            edges = edges.unionByName(extra.select(F.col("func").alias("cluster"), F.lit(name).alias("side"), entry(F.col("k")).alias("src"), (F.col("n") + 1).cast("int").alias("dst"), F.lit(None).cast("boolean").alias("label")))
        return blocks, edges

    (lb, le), (rb, re) = side("left"), side("right")
    return lb.unionByName(rb), le.unionByName(re)


#: Users with their number of blocks, the change in the copy, and the outputs of the first and the last block.
COPIES = f"""{EV}, sized AS (SELECT *, CASE kind WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 1 END + CASE WHEN k = 1 THEN 1 ELSE 0 END AS m FROM ev),
c AS (SELECT func AS cluster, func % 7 AS chg, max(n) AS n, max(m) FILTER (WHERE k = 1) AS m1, max(m) FILTER (WHERE k = n) AS m FROM sized GROUP BY func)"""


def classified(entry: str) -> str:
    """The classification that follows from the change; entry: what comes of another operation in the first block."""
    return f"""SELECT cluster, CASE chg WHEN 2 THEN 'SubsetAndExact' WHEN 3 THEN 'SupersetAndExact' {entry.split("|")[0]} ELSE 'ExactOnly' END AS fuzz,
  CASE chg WHEN 1 THEN 'Subset' {entry.split("|")[1]} WHEN 5 THEN 'Partial' WHEN 6 THEN 'Partial' ELSE 'Total' END AS overlap,
  CAST(CASE chg {entry.split("|")[2]} WHEN 5 THEN n - 1 WHEN 6 THEN n - 1 ELSE n END AS BIGINT) AS n, CAST(CASE chg WHEN 1 THEN n + 1 ELSE n END AS BIGINT) AS d,
  round(CASE chg WHEN 2 THEN (n - 1 + m / (m + 1)) / n WHEN 3 THEN (n - 1 + (m - 1) / m) / n {entry.split("|")[3]} ELSE 1 END, 6) AS mean FROM c"""


@query("m8_copies", f"WITH {COPIES} {classified('| WHEN 4 THEN ' + chr(39) + 'Partial' + chr(39) + ' | WHEN 4 THEN 0 | WHEN 4 THEN 0')}")
def _(s, d):
    return M.match_pairs(*copies(s, d)).withColumn("mean", F.round("mean", 6))


@query("m8_copies_fuzzy", f"WITH {COPIES} {classified('WHEN 4 THEN ' + chr(39) + 'Fuzzy' + chr(39) + ' | | | WHEN 4 THEN (n - 1 + (m1 - 1) / (m1 + 1)) / n')}")
def _(s, d):
    return M.match_pairs(*copies(s, d), "fuzzy-inline").withColumn("mean", F.round("mean", 6))


@query("m8_block_kinds", f"""WITH {COPIES}, k AS (SELECT n - CASE WHEN chg IN (2, 3, 4, 5, 6) THEN 1 ELSE 0 END AS exact, CASE WHEN chg = 2 THEN 1 ELSE 0 END AS sub, CASE WHEN chg = 3 THEN 1 ELSE 0 END AS sup, CASE WHEN chg = 4 THEN 1 ELSE 0 END AS part FROM c)
SELECT * FROM (SELECT 'Exact' AS kind, CAST(sum(exact) AS BIGINT) AS n FROM k UNION ALL SELECT 'Subset', CAST(sum(sub) AS BIGINT) FROM k UNION ALL SELECT 'Superset', CAST(sum(sup) AS BIGINT) FROM k UNION ALL SELECT 'Partial', CAST(sum(part) AS BIGINT) FROM k) WHERE n > 0""")
def _(s, d):
    return M.matched_blocks(*copies(s, d), "fuzzy-inline", pairings=False).groupBy("kind").agg(F.count("*").alias("n"))


@query("m8_matched_edges", f"""WITH {COPIES}, e AS (SELECT func AS cluster, k, k + 1 AS t, CASE WHEN kind = 'click' THEN false END AS label FROM ev WHERE k < n UNION ALL SELECT func, k, CASE WHEN value >= 80 THEN k ELSE k + 2 END, true FROM ev WHERE kind = 'click' AND (value >= 80 OR k + 2 <= n))
SELECT cluster, CAST(count(*) AS BIGINT) AS n_edges, CAST(count(label) AS BIGINT) AS n_labelled FROM e JOIN c USING (cluster) WHERE chg <> 4 AND (chg NOT IN (5, 6) OR (k < n AND t < n)) GROUP BY cluster""")
def _(s, d):
    return M.matched_edges(*copies(s, d)).groupBy("cluster").agg(F.count("*").alias("n_edges"), F.count("label").alias("n_labelled"))


@query("j18_output_candidates", f"""WITH {EV}, o AS (SELECT func, k, n, CASE kind WHEN 'signup' THEN '+' || (id % 16) WHEN 'view' THEN 'l' || (id % 4 * 4) WHEN 'purchase' THEN '*' || (id % 7) WHEN 'click' THEN '=' || (id % 3) ELSE '^' || (id % 5) END AS shape FROM ev UNION ALL SELECT func, k, n, '#' || (id % 4) FROM ev WHERE kind IN ('purchase', 'error') UNION ALL SELECT func, k, n, '#' || (id % 4) FROM ev WHERE kind = 'error' UNION ALL SELECT func, 1, n, 'p' FROM ev WHERE k = 1),
r AS (SELECT func, CASE WHEN func % 7 = 4 AND k = 1 AND shape NOT LIKE '#%' AND shape <> 'p' OR func % 7 = 6 AND k = n AND shape NOT LIKE '#%' AND shape <> 'p' THEN '-' ELSE shape END AS shape FROM o WHERE NOT (func % 7 = 3 AND k = n AND shape NOT LIKE '#%' AND shape <> 'p') UNION ALL SELECT func, 'q' FROM ev WHERE k = n AND func % 7 = 2 UNION ALL SELECT func, '#5' FROM ev WHERE k = n AND func % 7 = 1)
SELECT func AS cluster, CAST(sum(a.c * b.c) AS BIGINT) AS n FROM (SELECT func, shape, count(*) AS c FROM o GROUP BY ALL) a JOIN (SELECT func, shape, count(*) AS c FROM r GROUP BY ALL) b USING (func, shape) GROUP BY func""")
def _(s, d):
    blocks = copies(s, d)[0].where("output is not null")
    left, right = (blocks.where(F.col("side") == x).select("cluster", "output", "tree") for x in ("left", "right"))
    return M.candidate_outputs(left, right, ["cluster"]).groupBy("cluster").agg(F.count("*").alias("n"))


# Flags of a pair before and after the passes


def users(s, d):
    """func: the functions that programs makes."""
    return E.table(s, d, "events").select(F.col("user_id").alias("func")).distinct()


def program_copies(s, d):
    """programs beside a copy of each, under the number -1 - func: equal, with other names, with a jump to its first label before it, with a branch before it, with differences for sums."""
    t = programs(s, d)
    kind = F.col("func") % 5
    other = lambda c: F.when(kind == 1, F.regexp_replace(c, '"v([0-9])', '"w$1')).when(kind == 4, F.replace(c, F.lit('["bin","+",["var","v'), F.lit('["bin","-",["var","v'))).otherwise(c)
    copy = t.withColumn("tree", F.when(F.col("tree").contains('"load"'), F.when(kind == 1, F.regexp_replace("tree", '"v([0-9])', '"w$1')).otherwise(F.col("tree"))).otherwise(other(F.col("tree"))))
    copy = copy.withColumn("avar", F.when((kind == 1) & F.col("avar").rlike("^v[0-9]"), F.regexp_replace("avar", "^v", "w")).otherwise(F.col("avar")))
    none = F.lit(None).cast("string")
    row = lambda pos, k, avar, tree, target, other: F.struct(F.lit(pos).cast("long").alias("pos"), F.lit(k).alias("kind"), avar.alias("avar"), tree.alias("tree"), target.alias("target"), other.alias("other"))
    test = F.lit('["bin","==",["var","v0",32],["int",1,32]]')
    first = F.when(kind == 2, F.array(row(-2, "jmp", none, none, F.lit("N0"), none), row(-1, "label", F.lit("N0"), none, none, none)))
    first = first.when(kind == 3, F.array(row(-2, "cjmp", none, test, F.lit("end"), F.lit("N0")), row(-1, "label", F.lit("N0"), none, none, none)))
    more = users(s, d).select("func", F.inline(first))
    return t, copy.unionByName(more).withColumn("func", -1 - F.col("func"))


def copy_flags(s, d):
    """Flags of every program (l) and its copy (r)."""
    t, copy = program_copies(s, d)
    return P.pair_flags(users(s, d).select(F.col("func").alias("l"), (-1 - F.col("func")).alias("r")), P.shapes(t.unionByName(copy)))


PROGRAM_FLAGS = f"""{EV}, u AS (SELECT func, count(*) FILTER (WHERE kind = 'signup') AS sums FROM ev GROUP BY func),
flag AS (SELECT func AS l, -1 - func AS r, func % 5 = 0 OR (func % 5 = 4 AND sums = 0) AS identical, func % 5 = 1 OR (func % 5 = 4 AND sums > 0) AS iso_before, func % 17 > 0 AND func % 5 <> 3 AS iso_after FROM u)"""


@query("m9_pair_flags", f"WITH {PROGRAM_FLAGS} SELECT * FROM flag")
def _(s, d):
    return copy_flags(s, d)


@query("m9_flag_funnel", f"""WITH {PROGRAM_FLAGS} SELECT l % 10 AS grp, count(*) AS n_pairs, count(*) FILTER (WHERE identical) AS n_identical, count(*) FILTER (WHERE iso_before AND NOT identical) AS n_before, count(*) FILTER (WHERE iso_after AND NOT iso_before AND NOT identical) AS n_after,
  count(*) FILTER (WHERE NOT identical AND NOT iso_before AND NOT iso_after) AS n_left FROM flag GROUP BY grp""")
def _(s, d):
    f = copy_flags(s, d)
    first = F.when(F.col("identical"), "identical").when(F.col("iso_before"), "before").when(F.col("iso_after"), "after").otherwise("left")
    return f.withColumn("stage", first).groupBy((F.col("l") % 10).alias("grp")).agg(F.count("*").alias("n_pairs"), *[F.count_if(F.col("stage") == x).alias(f"n_{x}") for x in ("identical", "before", "after", "left")])


# Correspondences as tables: an order's statements name variables on the left and places on the right


def pairings(s, d, by):
    name = lambda side, prefix, c: F.struct(F.lit(side).alias("side"), F.concat(F.lit(prefix), F.col(c).cast("string")).alias("name"))
    return E.statements(s, d).select(F.col("func").alias("key"), by.alias("pairing"), F.inline(F.array(name("l", "v", "avar"), name("r", "w", "a"))))


PAIRINGS = f"""{E.STMT}, one AS (SELECT func AS key, '1:' || op AS pairing, 'l' AS side, 'v' || avar AS name FROM stmt UNION SELECT func, '1:' || op, 'r', 'w' || a FROM stmt),
two AS (SELECT func AS key, '2:' || (pos % 2) AS pairing, 'l' AS side, 'v' || avar AS name FROM stmt UNION SELECT func, '2:' || (pos % 2), 'r', 'w' || a FROM stmt)"""
PARTS = """named AS (SELECT key, side, name, array_to_string(list_sort(list(pairing)), ' & ') AS part FROM members GROUP BY key, side, name),
parts AS (SELECT key, part, count(*) FILTER (WHERE side = 'l') AS n_left, count(*) FILTER (WHERE side = 'r') AS n_right, string_agg(name, ',' ORDER BY name) FILTER (WHERE side = 'l') AS names FROM named GROUP BY key, part)"""


@query("m3_merged_parts", f"WITH {PAIRINGS}, members AS (SELECT * FROM one UNION SELECT * FROM two), {PARTS} SELECT key, part, CAST(n_left AS INTEGER) AS n_left, CAST(n_right AS INTEGER) AS n_right, coalesce(names, '') AS names, n_left = n_right AS agrees FROM parts")
def _(s, d):
    m = C.merged(pairings(s, d, F.col("op")), pairings(s, d, F.col("pos") % 2), ["key"])
    return m.select("key", F.array_join("part", " & ").alias("part"), F.size("left").alias("n_left"), F.size("right").alias("n_right"), F.array_join("left", ",").alias("names"), "agrees")


@query("m3_conflicts", f"WITH {PAIRINGS}, members AS (SELECT * FROM one UNION SELECT * FROM two), {PARTS} SELECT key, count(*) AS n FROM parts WHERE n_left <> n_right GROUP BY key")
def _(s, d):
    m = C.merged(pairings(s, d, F.col("op")), pairings(s, d, F.col("pos") % 2), ["key"])
    return C.conflicts(m, ["key"]).groupBy("key").agg(F.count("*").alias("n"))


@query("m4_simplified_parts", f"WITH {PAIRINGS}, members AS (SELECT * FROM one UNION SELECT * FROM two), {PARTS} SELECT key, list, CAST(n_left AS INTEGER) AS n_left, CAST(n_right AS INTEGER) AS n_right, coalesce(names, '') AS names FROM parts, (SELECT unnest([1, 2]) AS list) WHERE contains(part, list || ':')")
def _(s, d):
    m = C.simplified(pairings(s, d, F.col("op")), pairings(s, d, F.col("pos") % 2), ["key"])
    return m.select("key", "list", F.size("left").alias("n_left"), F.size("right").alias("n_right"), F.array_join("left", ",").alias("names"))


@query("m5_verified_pairs", f"""WITH {PAIRINGS}, members AS (SELECT * FROM one), {PARTS}, cand AS (SELECT DISTINCT func AS key, 'v' || avar AS l, 'w' || (b % 8) AS r FROM stmt)
SELECT c.key, c.l, c.r, a.part IS NOT DISTINCT FROM b.part AS holds FROM cand c LEFT JOIN named a ON a.key = c.key AND a.side = 'l' AND a.name = c.l LEFT JOIN named b ON b.key = c.key AND b.side = 'r' AND b.name = c.r""")
def _(s, d):
    cand = E.statements(s, d).select(F.col("func").alias("key"), F.concat(F.lit("v"), F.col("avar").cast("string")).alias("l"), F.concat(F.lit("w"), (F.col("b") % 8).cast("string")).alias("r")).distinct()
    return C.verified(pairings(s, d, F.col("op")), cand, ["key"])


@query("m2_terms_by_class", f"""WITH {E.STMT}, term AS (SELECT func AS key, CASE WHEN pos % 2 = 0 THEN 'l' ELSE 'r' END AS side, 't' || a AS name, CASE WHEN op = 'add' THEN CASE WHEN avar < 3 THEN 'reg' ELSE 'stack' END WHEN op = 'store' THEN 'global' ELSE 'heap' END AS kind, a % 2 * 4 AS low, a % 2 * 4 + 3 AS high, 'b' || avar AS base FROM stmt),
members AS (SELECT key, CASE WHEN kind IN ('reg', 'stack') THEN 'frame' WHEN kind = 'heap' THEN 'heap[' || low || ':' || high || ']' ELSE kind END AS pairing, side, name FROM term UNION SELECT key, 'base[' || low || ':' || high || ']', side, base FROM term WHERE kind = 'heap'), {PARTS}
SELECT key, part, CAST(n_left AS INTEGER) AS n_left, CAST(n_right AS INTEGER) AS n_right, n_left = n_right AS agrees FROM parts""")
def _(s, d):
    st = E.statements(s, d)
    kind = F.when(F.col("op") == "add", F.when(F.col("avar") < 3, "reg").otherwise("stack")).when(F.col("op") == "store", "global").otherwise("heap")
    low = F.col("a") % 2 * 4
    terms = st.select(F.col("func").alias("key"), F.when(F.col("pos") % 2 == 0, "l").otherwise("r").alias("side"), F.concat(F.lit("t"), F.col("a").cast("string")).alias("name"), kind.alias("kind"), low.alias("low"), (low + 3).alias("high"), F.concat(F.lit("b"), F.col("avar").cast("string")).alias("base"))
    p = C.parts(C.by_class(terms, ["key"]), ["key"])
    return p.select("key", F.array_join("part", " & ").alias("part"), F.size("left").alias("n_left"), F.size("right").alias("n_right"), "agrees")


# The way of correspondences: users' days as graphs; a step with a label puts out its target under a name that depends on the label


def flows(s, d):
    """(members, steps, seen)."""
    e = settled(E.edges(s, d))
    lab = F.when(F.col("label"), "1").otherwise("0")
    twin = lambda c: F.concat(F.col(c), F.lit("'"))
    put = e.where("label is not null").select(F.col("graph").alias("cluster"), F.col("src").alias("l"), twin("src").alias("r"), F.concat("dst", lab).alias("pairing"), F.array(F.struct(F.lit("l").alias("side"), F.col("dst").alias("name")), F.struct(F.lit("r").alias("side"), F.concat("dst", lab).alias("name"))).alias("m"))
    members = put.select("cluster", "l", "r", "pairing", F.inline("m")).distinct()
    steps = e.select(F.col("graph").alias("cluster"), F.col("src").alias("l"), twin("src").alias("r"), F.col("dst").alias("to_l"), twin("dst").alias("to_r")).distinct()
    names = members.select("cluster", "side", "name").distinct()
    blocks = steps.select("cluster", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("to_l").alias("block")), F.struct(F.lit("r").alias("side"), F.col("to_r").alias("block")))).alias("b")).select("cluster", "b.side", "b.block").distinct()
    # A name is of no use in a block with as many letters as its own variable's block has.
    base = lambda c: F.length(F.regexp_replace(c, "[01']", ""))
    seen = names.join(blocks, ["cluster", "side"]).where(base("name") != base("block")).select("cluster", "side", "block", "name")
    return members, steps, seen


FLOWS = f"""{E.edge_sql()}, put AS (SELECT DISTINCT graph, src AS v, dst AS name, CASE WHEN label THEN '1' ELSE '0' END AS way FROM edge WHERE label IS NOT NULL),
fl AS (SELECT graph, v, name, way, v AS src0 FROM put UNION SELECT f.graph, e.dst, f.name, f.way, f.src0 FROM fl f JOIN edge e ON e.graph = f.graph AND e.src = f.v WHERE length(f.name) <> length(e.dst))"""


@query("m8_flowed_pairings", f"WITH RECURSIVE {FLOWS} SELECT graph AS cluster, v AS l, count(*) AS n FROM fl GROUP BY graph, v")
def _(s, d):
    return C.propagated(*flows(s, d)).groupBy("cluster", "l").agg(F.count("*").alias("n"))


@query("m8_settled_pairs", f"""WITH RECURSIVE {FLOWS}, members AS (SELECT DISTINCT graph, v, name || way || src0 AS pairing, 'l' AS side, name FROM fl UNION SELECT DISTINCT graph, v, name || way || src0, 'r', name || way FROM fl),
named AS (SELECT graph, v, side, name, list_sort(list(DISTINCT pairing)) AS part FROM members GROUP BY graph, v, side, name), bad AS (SELECT DISTINCT graph, v FROM (SELECT graph, v, part FROM named GROUP BY graph, v, part HAVING count(*) FILTER (WHERE side = 'l') <> count(*) FILTER (WHERE side = 'r')))
SELECT x.graph AS cluster, x.v AS l, b.v IS NULL AS agrees FROM (SELECT graph, src AS v FROM edge UNION SELECT graph, dst FROM edge) x LEFT JOIN bad b ON b.graph = x.graph AND b.v = x.v""")
def _(s, d):
    members, steps, seen = flows(s, d)
    pairs = steps.select("cluster", "l", "r").unionByName(steps.select("cluster", F.col("to_l").alias("l"), F.col("to_r").alias("r"))).distinct()
    return C.settled_pairs(pairs, steps, members.limit(0), members, seen).select("cluster", "l", "agrees")


# Dataflow with a lattice, and path bounds


STEP = "CASE WHEN src = 'error' THEN NULL WHEN src = 'click' THEN 4 WHEN src = 'view' THEN -4 ELSE 0 END"


def steps_of(e):
    return F.when(F.col("src") == "error", F.lit(None)).when(F.col("src") == "click", 4).when(F.col("src") == "view", -4).otherwise(0).cast("long")


FIRST = "ent AS (SELECT graph, min(v) AS v FROM (SELECT graph, src AS v FROM edge UNION SELECT graph, dst FROM edge) GROUP BY graph)"


@query("g23_flat_heights", f"""WITH RECURSIVE {E.edge_sql()}, {FIRST}, w AS (SELECT graph, v, CAST(0 AS BIGINT) AS h, 0 AS k FROM ent UNION SELECT w.graph, e.dst, w.h + {STEP}, k + 1 FROM w JOIN (SELECT DISTINCT graph, src, dst FROM edge) e ON e.graph = w.graph AND e.src = w.v WHERE k < 11)
SELECT graph, v, CASE WHEN count(DISTINCT h) = 1 AND bool_and(h IS NOT NULL) THEN max(h) END AS height FROM w GROUP BY graph, v""")
def _(s, d):
    e = E.edges(s, d).select("graph", "src", "dst").distinct()
    steps = e.select("graph", "src").distinct().select("graph", F.col("src").alias("v"), steps_of(e).alias("step"))
    return L.heights(e, steps, G.vertices(e).groupBy("graph").agg(F.min("v").alias("v")))


@query("g25_any_flow", f"""WITH RECURSIVE {E.edge_sql()}, fl AS (SELECT DISTINCT graph, dst AS v FROM edge WHERE label UNION SELECT e.graph, e.src FROM fl JOIN edge e ON e.graph = fl.graph AND e.dst = fl.v WHERE e.label IS NULL OR NOT e.label) SELECT graph, v FROM fl""")
def _(s, d):
    e = E.edges(s, d)
    start = e.where("label").select("graph", F.col("dst").alias("v"), F.lit(True).alias("value")).distinct()
    lattice = L.Lattice(F.bool_or, lambda x: F.when(F.col("label").isNull() | ~F.col("label"), x))
    return L.flow(e, start, lattice, backward=True).where("value").select("graph", "v")


WEIGHTS = """wt AS (SELECT graph, src, dst, min(CASE WHEN label IS NULL THEN length(src) - length(dst) WHEN label THEN 3 ELSE -2 END) AS lo, max(CASE WHEN label IS NULL THEN length(src) - length(dst) WHEN label THEN 3 ELSE -2 END) AS hi FROM edge GROUP BY graph, src, dst)"""


def weighted(s, d):
    """graph, src, dst, low, high."""
    e = E.edges(s, d)
    w = F.when(F.col("label").isNull(), F.length("src") - F.length("dst")).when(F.col("label"), 3).otherwise(-2).cast("long")
    return e.withColumn("w", w).groupBy("graph", "src", "dst").agg(F.min("w").alias("low"), F.max("w").alias("high"))


#: Every simple path with its sums, and the simple cycles.
PATHS = """simple AS (SELECT graph, src AS a, dst AS b, [src, dst] AS path, lo, hi FROM wt WHERE src <> dst UNION ALL SELECT s.graph, s.a, w.dst, list_append(s.path, w.dst), s.lo + w.lo, s.hi + w.hi FROM simple s JOIN wt w ON w.graph = s.graph AND w.src = s.b WHERE NOT list_contains(s.path, w.dst)),
cyc AS (SELECT graph, src AS v, lo, hi FROM wt WHERE src = dst UNION ALL SELECT s.graph, s.a, s.lo + w.lo, s.hi + w.hi FROM simple s JOIN wt w ON w.graph = s.graph AND w.src = s.b AND w.dst = s.a)"""


@query("g19_offset_bounds", f"""WITH RECURSIVE {E.edge_sql()}, {WEIGHTS}, {FIRST}, {PATHS}, away AS (SELECT DISTINCT graph, a, b FROM simple UNION SELECT graph, v, v FROM ent), bad AS (SELECT x.graph, y.b AS v, bool_or(c.lo < 0) AS lo, bool_or(c.hi > 0) AS hi FROM ent JOIN away x ON x.graph = ent.graph AND x.a = ent.v JOIN cyc c ON c.graph = x.graph AND c.v = x.b JOIN (SELECT graph, a, b FROM away UNION SELECT graph, v, v FROM cyc) y ON y.graph = x.graph AND y.a = x.b GROUP BY ALL),
best AS (SELECT s.graph, s.b AS v, min(s.lo) AS low, max(s.hi) AS high FROM simple s JOIN ent ON ent.graph = s.graph AND ent.v = s.a GROUP BY ALL UNION ALL SELECT graph, v, 0, 0 FROM ent)
SELECT best.graph, best.v, CAST(CASE WHEN coalesce(bad.lo, false) THEN NULL ELSE low END AS BIGINT) AS low, CAST(CASE WHEN coalesce(bad.hi, false) THEN NULL ELSE high END AS BIGINT) AS high FROM best LEFT JOIN bad USING (graph, v)""")
def _(s, d):
    w = weighted(s, d)
    return L.offset_bounds(w, G.vertices(w).groupBy("graph").agg(F.min("v").alias("v")))


@query("g20_cycle_signs", f"""WITH RECURSIVE {E.edge_sql()}, {WEIGHTS}, {PATHS} SELECT w.graph, bool_or(coalesce(c.lo < 0, false)) AS negative, bool_or(coalesce(c.hi > 0, false)) AS positive FROM (SELECT DISTINCT graph FROM wt) w LEFT JOIN cyc c USING (graph) GROUP BY w.graph""")
def _(s, d):
    return L.cycle_signs(weighted(s, d))


@query("g26_interval_flow", f"""WITH RECURSIVE {E.edge_sql()}, {WEIGHTS}, {PATHS}, acyc AS (SELECT * FROM wt WHERE graph NOT IN (SELECT graph FROM cyc)), ent AS (SELECT graph, min(v) AS v FROM (SELECT graph, src AS v FROM acyc UNION SELECT graph, dst FROM acyc) GROUP BY graph)
SELECT s.graph, s.b AS v, CAST(min(s.lo) AS BIGINT) AS lo, CAST(max(s.hi) AS BIGINT) AS hi FROM simple s JOIN ent ON ent.graph = s.graph AND ent.v = s.a GROUP BY ALL UNION ALL SELECT graph, v, 0, 0 FROM ent""")
def _(s, d):
    w = weighted(s, d)
    w = w.join(G.cyclic(w).select("graph").distinct(), "graph", "left_anti")
    start = G.vertices(w).groupBy("graph").agg(F.min("v").alias("v")).withColumn("value", L.between(F.lit(0), F.lit(0)))
    return L.flow(w, start, L.ranges(F.col("low"), F.col("high"))).select("graph", "v", "value.lo", "value.hi")


# Measures, levels of reduction, verdicts


@query("n12_eight_measures", f"""WITH RECURSIVE {E.edge_sql()}, vs AS (SELECT graph, src AS v FROM edge UNION SELECT graph, dst FROM edge), ent AS (SELECT graph, min(v) AS r FROM vs GROUP BY graph),
walk AS (SELECT graph, r AS v FROM ent UNION SELECT w.graph, e.dst FROM walk w JOIN edge e ON e.graph = w.graph AND e.src = w.v),
cut AS (SELECT w.graph, w.v AS x, ent.r AS v FROM walk w JOIN ent ON ent.graph = w.graph WHERE w.v <> ent.r UNION SELECT c.graph, c.x, e.dst FROM cut c JOIN edge e ON e.graph = c.graph AND e.src = c.v AND e.dst <> c.x),
dom AS (SELECT w.graph, o.v AS d, w.v FROM walk w JOIN walk o ON o.graph = w.graph AND o.v <> w.v ANTI JOIN cut c ON c.graph = w.graph AND c.x = o.v AND c.v = w.v),
outs AS (SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS graph, event_type AS block, event_id FROM events), place AS (SELECT w.graph, w.v, (SELECT count(*) FROM dom WHERE dom.graph = w.graph AND dom.v = w.v) AS up, (SELECT count(*) FROM dom WHERE dom.graph = w.graph AND dom.d = w.v) AS down FROM walk w)
SELECT o.graph, o.event_id AS output, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 ELSE 3 END AS depth, CASE WHEN event_id % 3 = 0 THEN 11 WHEN event_id % 3 = 1 THEN 5 ELSE 0 END AS root, count(*) OVER (PARTITION BY o.graph, block) AS n_outputs, (SELECT count(*) FROM vs WHERE vs.graph = o.graph) AS n_blocks,
  up AS dom_depth, CASE WHEN down > 0 THEN 1 WHEN down = 0 THEN 0 END AS is_dominator, down AS n_dominated, up AS n_dominators FROM outs o JOIN ent ON ent.graph = o.graph LEFT JOIN place p ON p.graph = o.graph AND p.v = block""")
def _(s, d):
    e = E.edges(s, d)
    ev = E.table(s, d, "events")
    var, k = '["var","a",32]', F.col("event_id") % 3
    tree = F.when(k == 0, var).when(k == 1, f'["bin","+",{var},["int",1,32]]').otherwise(f'["load",["var","mem",0],["bin","+",{var},["int",4,32]],32]')
    outs = ev.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("graph"), F.col("event_type").alias("block"), F.col("event_id").alias("output"), tree.alias("tree"))
    outs = outs.join(e.select("graph").distinct(), "graph", "left_semi")
    return ME.output_measures(outs, e).select("graph", "output", *ME.MEASURES)


@query("c8_reduced_in_levels", "SELECT CAST(grp AS BIGINT) AS grp, CAST(min(item) AS BIGINT) AS first, count(*) AS n, CAST(sum(item) AS BIGINT) AS items FROM (SELECT o_custkey % 5 AS grp, o_orderkey AS item, CAST(floor(o_totalprice) AS BIGINT) % 101 AS key FROM orders) GROUP BY grp, key")
def _(s, d):
    o = E.table(s, d, "orders").select((F.col("o_custkey") % 5).alias("grp"), F.col("o_orderkey").alias("item"), F.floor("o_totalprice").cast("long").alias("value"))
    b = R.reduced_buckets(o, lambda a, b: a % 101 == b % 101)
    return b.groupBy("grp", "first").agg(F.count("*").alias("n"), F.sum("item").alias("items"))


@query("c11_verdict_memo", """WITH a AS (SELECT l_linenumber AS grp, least(l_partkey, l_suppkey) AS l, greatest(l_partkey, l_suppkey) AS r, l_returnflag = 'A' AS verdict FROM lineitem),
m AS (SELECT grp, l, r, count(*) AS n, min(verdict) AS lo, max(verdict) AS hi FROM a GROUP BY grp, l, r) SELECT grp, CAST(sum(n) AS BIGINT) AS n_asked, CAST(sum(n - 1) AS BIGINT) AS n_hits, round(sum(n - 1) / sum(n), 6) AS rate, count(*) FILTER (WHERE lo <> hi) AS n_errors, count(*) FILTER (WHERE lo = hi AND lo) AS n_equal FROM m GROUP BY grp""")
def _(s, d):
    t = E.table(s, d, "lineitem").select(F.col("l_linenumber").alias("grp"), F.col("l_partkey").alias("l"), F.col("l_suppkey").alias("r"), (F.col("l_returnflag") == "A").alias("verdict"))
    memo = R.verdict_memo(t, ["grp"])
    errors = memo.groupBy("grp").agg(F.count("error").alias("n_errors"), F.count_if("verdict").alias("n_equal"))
    return R.hit_rate(memo, ["grp"]).join(errors, "grp")


# Programs whose data trigger what passes and analyses are for


def rich_programs(s, d):
    """Statements as programs has them, of users whose events make blocks out of reach, several ends with a common tail, negated branches on one-bit flags, chains of empty blocks, constants, copies and narrow uses.

    signup: a constant to e, and a sum of it. view: bytes of n (low, second, or both) to the frame. purchase: a flag, of an equality. click: a branch on a flag, negated for odd numbers; from value 80 on to an end of its own. error: a call, abort for every tenth, or a jump over the next label by way of two empty blocks.
    """
    e = events(s, d)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    var = lambda name, n, w=32: text(f'["var","{name}', n, f'",{w}]')
    num = lambda n: text('["int",', n, ",32]")
    i, k, none = F.col("id"), F.col("k"), F.lit(None).cast("string")
    row = lambda at, kind, avar=none, tree=none, target=none, other=none: F.struct((16 * k + at).cast("long").alias("pos"), F.lit(kind).alias("kind"), avar.alias("avar"), tree.alias("tree"), target.alias("target"), other.alias("other"))
    label = lambda n: F.when(n > F.col("n"), "end").otherwise(text("L", n))
    place = text('["bin","+",["var","esp",32],', num(i % 4 * 4), "]")
    byte = lambda part: text(part, var("n", i % 3), "]")
    narrow = F.when(i % 3 == 0, byte('["cast","low",8,')).when(i % 3 == 1, byte('["extract",15,8,')).otherwise(byte('["extract",15,0,'))
    width = F.when(i % 3 == 2, 16).otherwise(8)
    flag = var("f", i % 3, 1)
    condition = F.when(i % 2 == 1, text('["un","~",', flag, "]")).otherwise(flag)
    last = [row(8, "move", F.lit("eax"), F.lit('["var","v0",32]')), row(9, "halt")]
    body = (
        F.when(F.col("kind") == "signup", F.array(row(1, "move", text("e", i % 3), num(i % 50)), row(2, "move", text("v", i % 4), text('["bin","+",', var("e", i % 3), ",", num(i % 7), "]"))))
        .when(F.col("kind") == "view", F.array(row(1, "move", F.lit("mem"), text('["store",["var","mem",0],', place, ",", narrow, ",", width, "]")), row(2, "move", text("v", i % 4), text('["load",["var","mem",0],', place, ",32]"))))
        .when(F.col("kind") == "purchase", F.array(row(1, "move", text("f", i % 3), text('["bin","==",', var("v", i % 4), ",", num(i % 5), "]")), row(2, "move", text("u", i % 2), text('["bin","+",', var("u", (i + 1) % 2), ",", num(i % 3 + 1), "]"))))
        .when((F.col("kind") == "click") & (F.col("value") >= 80), F.array(row(1, "cjmp", tree=condition, target=text("X", k), other=label(k + 1)), row(7, "label", text("X", k)), *last))
        .when(F.col("kind") == "click", F.array(row(1, "cjmp", tree=condition, target=label(k + 2), other=label(k + 1))))
        .when(i % 3 == 0, F.array(row(1, "jmp", target=text("N", k)), row(2, "label", text("N", k)), row(3, "jmp", target=text("M", k)), row(4, "label", text("M", k)), row(5, "jmp", target=label(k + 2))))
        .otherwise(F.array(row(1, "call", F.when(i % 10 == 0, "abort").otherwise(text("g", i % 9)))))
    )
    head = F.array(row(0, "label", text("L", k)))
    end = F.array(row(16, "label", F.lit("end")), row(24, "move", F.lit("eax"), F.lit('["var","v0",32]')), row(25, "halt"))
    rows = e.select("func", F.inline(F.concat(head, body))).unionByName(e.where("k = n").select("func", F.inline(end)))
    return rows.select("func", "pos", "kind", "avar", "tree", "target", "other")


@query("k8_rich_snapshots")
def _(s, d):
    from ..sources.sinks import pass_snapshots, snapshots

    return snapshots(pass_snapshots(rich_programs(s, d))).groupBy("no", "name").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"), F.count_if("cfg_changed").alias("n_cfg_changed"))


@query("u2_flags_of_branches", f"""WITH RECURSIVE {EV}, step AS (SELECT func, k, CASE WHEN kind = 'error' AND id % 3 = 0 THEN k + 2 ELSE k + 1 END AS t FROM ev UNION ALL SELECT func, k, k + 2 FROM ev WHERE kind = 'click' AND value < 80),
reach AS (SELECT DISTINCT func, CAST(1 AS BIGINT) AS k FROM ev UNION SELECT r.func, s.t FROM reach r JOIN step s ON s.func = r.func AND s.k = r.k)
SELECT func, 'f' || (id % 3) AS var, count(*) AS n FROM ev JOIN reach USING (func, k) WHERE kind = 'click' GROUP BY ALL""")
def _(s, d):
    return P.branch_flags(rich_programs(s, d)).groupBy("func", F.substring_index("var", ".", 1).alias("var")).agg(F.count_distinct("block").alias("n"))


@query("n11_narrow_uses", f"""WITH {EV}, v AS (SELECT func, 'n' || (id % 3) AS var, id % 3 AS r FROM ev WHERE kind = 'view')
SELECT func, var, CASE WHEN r = 1 THEN 8 ELSE 0 END AS low, CASE WHEN r = 2 THEN 16 ELSE 8 END AS bits FROM (SELECT DISTINCT * FROM v)""")
def _(s, d):
    return P.used_bits_table(rich_programs(s, d)).where("var like 'n%'")


@query("g26_constant_sets", f"""WITH {EV}, t AS (SELECT *, count(*) FILTER (WHERE kind = 'signup') OVER (PARTITION BY func ORDER BY k ROWS UNBOUNDED PRECEDING) AS c, arg_max(id % 50, CASE WHEN kind = 'signup' THEN k END) OVER (PARTITION BY func ORDER BY k ROWS UNBOUNDED PRECEDING) AS e FROM ev)
SELECT func, 'w.' || row_number() OVER (PARTITION BY func ORDER BY k) AS var, CAST(CASE WHEN c = 0 THEN 1 ELSE 0 END AS BIGINT) AS stride, CAST(CASE WHEN c = 0 THEN -2147483648 ELSE 3 * e - id % 9 END AS BIGINT) AS lo, CAST(CASE WHEN c = 0 THEN 2147483647 ELSE 3 * e - id % 9 END AS BIGINT) AS hi FROM t WHERE kind = 'view'""")
def _(s, d):
    # Straight-line: a signup sets e, a view takes three of it less a constant; before the first signup e is an input.
    e = events(s, d).where("kind in ('signup', 'view')")
    none = F.lit(None).cast("string")
    num = lambda n: F.concat(F.lit('["int",'), n.cast("string"), F.lit(",32]"))
    tree = F.when(F.col("kind") == "signup", num(F.col("id") % 50)).otherwise(F.concat(F.lit('["bin","-",["bin","*",["var","e",32],["int",3,32]],'), num(F.col("id") % 9), F.lit("]")))
    rows = e.select("func", (F.col("k") + 1).alias("pos"), F.lit("move").alias("kind"), F.when(F.col("kind") == "signup", "e").otherwise("w").alias("avar"), tree.alias("tree"), none.alias("target"), none.alias("other"))
    ends = e.select("func").distinct().select("func", F.lit(1 << 40).cast("long").alias("pos"), F.lit("halt").alias("kind"), none.alias("avar"), none.alias("tree"), none.alias("target"), none.alias("other"))
    return P.value_sets(rows.unionByName(ends)).where("var like 'w.%'")


@query("g26_joined_sets")
def _(s, d):
    """Finite sets where ways with several constants meet, of the programs with branches."""
    return P.value_sets(rich_programs(s, d)).where("lo > -2147483648 and hi < 2147483647").groupBy("func").agg(F.count("*").alias("n"), F.count_if(F.col("hi") > F.col("lo")).alias("n_wide"), F.max("hi").alias("hi"))


# Rewrites as tables


@query("f10_a28_block_facts", f"""WITH {EV}, b AS (SELECT func AS graph, k AS block, kind, value, id FROM ev UNION ALL SELECT func, n + 1, 'end', 0, 0 FROM ev WHERE k = n),
x AS (SELECT *, kind = 'error' AND id % 3 > 0 AS call, kind = 'end' OR (kind = 'click' AND value >= 80) AS halts FROM b)
SELECT graph, block, call AS is_nop, NOT call AS has_code, false AS only_halts, halts AS ends_in_halt, CASE WHEN kind = 'error' AND id % 3 = 0 THEN 3 WHEN kind = 'click' AND value >= 80 THEN 2 ELSE 1 END AS n_labels FROM x""")
def _(s, d):
    from ..operators.rewrites import block_facts

    t = rich_programs(s, d).select(F.col("func").alias("graph"), F.expr("pos div 16").alias("block"), "pos", "kind")
    return block_facts(t)


def lines_as_blocks(s, d):
    """(statements, edges) of orders: three statements are a block, which leads to the next; a store is a call."""
    t = settled(E.statements(s, d).select(F.col("func").alias("graph"), F.expr("(pos - 1) div 3").alias("block"), "pos", "op"))
    e = t.select("graph", "block").distinct().select("graph", F.col("block").alias("src"), (F.col("block") + 1).alias("dst"), F.lit(None).cast("boolean").alias("label"))
    return t, e


BROKEN = f"""{E.STMT}, t AS (SELECT func AS graph, (pos - 1) // 3 AS block, pos, op FROM stmt), p AS (SELECT *, coalesce(count(*) FILTER (WHERE op = 'store') OVER (PARTITION BY graph, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM t),
nm AS (SELECT *, CASE WHEN k = 0 THEN CAST(block AS VARCHAR) ELSE block || '+' || k END AS name FROM p)"""


@query("g11_broken_statements", f"WITH {BROKEN} SELECT graph, name AS block, count(*) AS n, max(op = 'store') AS has_call FROM nm GROUP BY graph, name")
def _(s, d):
    from ..operators.rewrites import broken_after_calls

    t, e = lines_as_blocks(s, d)
    return broken_after_calls(t, e, F.col("op") == "store")[0].groupBy("graph", "block").agg(F.count("*").alias("n"), F.max(F.col("op") == "store").alias("has_call"))


@query("g11_broken_edges", f"""WITH {BROKEN}, l AS (SELECT graph, block, max(k) AS k FROM nm GROUP BY ALL), pc AS (SELECT DISTINCT graph, block, k, name FROM nm)
SELECT a.graph, a.name AS src, b.name AS dst FROM pc a JOIN pc b ON a.graph = b.graph AND a.block = b.block AND b.k = a.k + 1 UNION ALL SELECT pc.graph, name, CAST(pc.block + 1 AS VARCHAR) FROM pc JOIN l USING (graph, block, k)""")
def _(s, d):
    from ..operators.rewrites import broken_after_calls

    t, e = lines_as_blocks(s, d)
    return broken_after_calls(t, e, F.col("op") == "store")[1].select("graph", "src", "dst")


@query("g12_without_returns", f"""WITH RECURSIVE {E.edge_sql()}, {FIRST}, lf AS (SELECT * FROM edge WHERE NOT (src = 'error' AND label IS NULL)), w AS (SELECT graph, v FROM ent UNION SELECT w.graph, e.dst FROM w JOIN lf e ON e.graph = w.graph AND e.src = w.v) SELECT e.* FROM lf e JOIN w ON w.graph = e.graph AND w.v = e.src""")
def _(s, d):
    from ..operators.rewrites import without_returns

    e = E.edges(s, d)
    return without_returns(e, e.where("src = 'error'").select("graph", F.col("src").alias("v")), G.vertices(e).groupBy("graph").agg(F.min("v").alias("v")))


def branches(s, d):
    """(branches, edges): clicks as branches under none to three negations, of an equality or an inequality."""
    e = events(s, d).where("kind = 'click'").select(F.col("func").alias("graph"), F.col("k").alias("block"), "id", "value")
    n = (F.col("id") % 4).cast("int")
    inner = F.concat(F.when(F.col("value") < 50, F.lit('["bin","!=",')).otherwise(F.lit('["bin","==",')), F.lit('["var","v"'), F.lit(',32],["int",'), F.col("id").cast("string"), F.lit(",32]]"))
    t = e.select("graph", "block", F.concat(F.repeat(F.lit('["un","~",'), n), inner, F.repeat(F.lit("]"), n)).alias("condition"))
    edge = lambda to, label: F.struct(F.col("block").alias("src"), (F.col("block") + to).alias("dst"), F.lit(label).alias("label"))
    return t, t.select("graph", F.inline(F.array(edge(1, False), edge(2, True))))


@query("g22_normal_branches", f"""WITH {EV} SELECT func AS graph, k AS block, '["bin","==",["var","v",32],["int",' || id || ',32]]' AS condition, (id % 4 + CASE WHEN value < 50 THEN 1 ELSE 0 END) % 2 = 0 AS far FROM ev WHERE kind = 'click'""")
def _(s, d):
    from ..operators.rewrites import normal_branches

    t, e = normal_branches(*branches(s, d))
    far = e.where("dst = src + 2").select("graph", F.col("src").alias("block"), F.col("label").alias("far"))
    return t.join(far, ["graph", "block"])


EXITS = f"""{E.STMT}, r AS (SELECT func % 50 AS g, func, pos, op, row_number() OVER (PARTITION BY func ORDER BY pos DESC) AS k FROM stmt), n AS (SELECT g, count(DISTINCT func) AS m FROM r GROUP BY g HAVING count(DISTINCT func) > 1),
p AS (SELECT g, k, count(*) AS c, count(DISTINCT op) AS v FROM r GROUP BY g, k), bad AS (SELECT p.g, min(k) AS k FROM p JOIN n ON n.g = p.g WHERE c <> m OR v > 1 GROUP BY p.g),
len AS (SELECT n.g, coalesce((SELECT k - 1 FROM bad WHERE bad.g = n.g), (SELECT max(k) FROM p WHERE p.g = n.g)) AS length FROM n)"""


def exits_of_groups(s, d):
    """(statements, edges): fifty graphs, whose blocks are orders that all lead to the exit."""
    t = settled(E.statements(s, d).select((F.col("func") % 50).cast("string").alias("graph"), F.col("func").cast("string").alias("block"), "pos", F.col("op").alias("text")))
    return t, t.select("graph", F.col("block").alias("src"), F.lit("exit").alias("dst"), F.lit(None).cast("boolean").alias("label")).distinct()


@query("g10_single_exit", f"""WITH {EXITS}, x AS (SELECT r.g, func, CAST(k <= coalesce(length, 0) AS INTEGER) AS gone FROM r LEFT JOIN len USING (g)) SELECT CAST(g AS VARCHAR) AS graph, CAST(count(*) FILTER (WHERE gone = 0) + any_value(coalesce(l.length, 0)) AS BIGINT) AS n_left, CAST(any_value(coalesce(l.length, 0)) AS BIGINT) AS n_tail, CAST(count(DISTINCT func) + 1 AS BIGINT) AS n_edges FROM x LEFT JOIN len l USING (g) GROUP BY g""")
def _(s, d):
    from ..operators.rewrites import single_exit

    t, e = single_exit(*exits_of_groups(s, d))
    left = t.groupBy("graph").agg(F.count("*").alias("n_left"), F.count_if(F.col("block") == "tail").alias("n_tail"))
    return left.join(e.groupBy("graph").agg(F.count("*").alias("n_edges")), "graph")


@query("f14_plausible_sinks", """WITH st AS (SELECT l_orderkey AS graph, l_linenumber % 2 AS var, l_linenumber AS way, l_suppkey % 4 AS sink, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS p FROM lineitem),
ws AS (SELECT graph, var, way, max(sink) AS sink, bool_or(p) AS sure FROM st GROUP BY graph, var, way HAVING NOT coalesce(bool_or(NOT p), false)),
w AS (SELECT graph, var, sink, bool_or(coalesce(sure, false)) AS sure FROM ws GROUP BY graph, var, sink), n AS (SELECT graph, var, count(*) FILTER (WHERE sure) AS n FROM w GROUP BY ALL)
SELECT graph, var, sink, CAST(NULL AS VARCHAR) AS reason FROM w JOIN n USING (graph, var) WHERE n.n < 2 UNION ALL SELECT graph, var, NULL, 'several pointers' FROM n WHERE n.n >= 2""")
def _(s, d):
    from ..operators.rewrites import plausible_sinks

    t = E.table(s, d, "lineitem")
    p = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    return plausible_sinks(t.select(F.col("l_orderkey").alias("graph"), (F.col("l_linenumber") % 2).alias("var"), F.col("l_linenumber").alias("way"), (F.col("l_suppkey") % 4).alias("sink"), p.alias("is_pointer")))
