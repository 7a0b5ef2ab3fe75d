from collections import defaultdict

from helpers import ODD, frame, sample, sha

from simforge.llm.common import setting
from simforge.llm.lines import ORDERED, LineRuns, line_dedup, op5_line_dedup, without_repeated_lines


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    low = -(2**63)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(low if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and (low if i is None else i) < max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return sorted(out, key=repr)


def run(df):
    from pyspark.sql import functions as F

    out = line_dedup(df)
    return sorted([tuple(r) for r in out.select("_row.doc_id", F.size("_dropped").alias("d"), "_lines", "_kept").select("doc_id", "_lines", "d", F.sha2("_kept", 256)).collect()], key=repr)


def test_against_brute_force(spark):
    line = "This very line stands in many documents. "
    rows = sample(spark) + [(10_000 + i, f"{line}\nown {i} line that only stands here\n  {line.upper()}") for i in range(9)] + [(i and i + 20_000, t) for i, t in ODD]
    assert run(frame(spark, rows, extra=True)) == brute(rows)


def test_empty(spark):
    assert run(frame(spark, [])) == []


def test_pipeline_form_keeps_columns_and_documents(spark):
    line = "This very line stands in many documents."
    df = frame(spark, [(i, f"{line}\nrest {i}") for i in range(4)] + [(9, None)])
    out = without_repeated_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {0: ("rest 0", 6), 1: ("rest 1", 6), 2: ("rest 2", 6), 3: (f"{line}\nrest 3", len(line) + 7), 9: (None, None)}


def test_runs_are_levelled(spark):
    runs = LineRuns(spark, fanout=2)
    batch = lambda *x: spark.createDataFrame([(bytes([h]) * 16, d) for h, d in x], "h binary, doc_id long")
    rows = lambda run: {r.h[0]: (r.n_docs, r.max_doc) for r in run.rows().collect()}
    runs.add(batch((1, 1), (1, 1), (2, 1)))
    assert rows(runs.levels[0][0]) == {1: (1, 1), 2: (1, 1)} and runs.updates == []
    runs.add(batch((1, 2), (3, 2)))
    assert [len(x) for x in runs.levels] == [0, 1]
    assert rows(runs.levels[1][0]) == {1: (1, 1), 2: (1, 1), 3: (1, 2)} and rows(runs.updates[0]) == {1: (1, 2)}
    runs.add(batch((1, 3), (4, 3)))
    assert rows(runs.levels[0][0]) == {4: (1, 3)} and rows(runs.updates[1]) == {1: (1, 3)}
    want = {1: (3, 3), 2: (1, 1), 3: (1, 2), 4: (1, 3)}
    assert {r.h[0]: (r.n_docs, r.max_doc) for r in runs.totals().collect()} == want
    runs.add(batch((4, 5)))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert {r.h[0]: (r.n_docs, r.max_doc) for r in runs.totals().collect()} == want | {4: (2, 5)}
    runs.drop()
    assert runs.totals() is None


def test_the_anti_join_decides(spark, monkeypatch):
    """Were each batch to own all of its keys, counts of keys that several batches bring would be lost."""
    line = "This very line stands in many documents."
    rows = [(i, f"{line}\nown {i} line that only stands here") for i in range(40)]
    assert run(frame(spark, rows)) == brute(rows)
    # A probe that finds nothing.
    real = LineRuns._runs
    runs = LineRuns(spark)
    for b in range(4):
        monkeypatch.setattr(LineRuns, "_runs", lambda self: [])
        runs.add(spark.createDataFrame([(bytes([7]) * 16, 10 * b + d) for d in range(10)], "h binary, doc_id long"))
        monkeypatch.setattr(LineRuns, "_runs", real)
    assert [r.n_docs for r in runs.totals().collect()] == [10]
    runs.drop()


def test_merges_shuffle_and_sort_nothing_but_the_batch(spark):
    runs = LineRuns(spark, fanout=9)
    for d in range(3):
        runs.add(spark.createDataFrame([(bytes([h]) * 16, d) for h in range(20)], "h binary, doc_id long"))
    with setting(spark, ORDERED, "true"):
        first, second, third = runs.levels[0]
        plans = [LineRuns._merged([first, second]), first.rows().join(second.rows().select("h").hint("merge"), "h", "left_anti").join(third.rows().select("h").hint("merge"), "h", "left_anti")]
        for plan in [p._jdf.queryExecution().executedPlan().toString() for p in plans]:
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.drop()


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op5_line_dedup(spark, "/root/testdata/sf0.01").collect()], key=repr) == brute(rows)
