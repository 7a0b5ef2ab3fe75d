import re

import corpus_pipeline
import test_jaccard
import test_lines
import test_packing
import test_quality
from helpers import ODD, frame
from test_secrets import base

from simforge.llm.secrets import redacted

SF = "/root/testdata/sf0.01"


def lines_out(rows):
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(test_lines.key(x)) >= 20:
                held.setdefault(test_lines.key(x), set()).add(i)
    return [(i, "\n".join(x for x in t.split("\n") if len(held.get(test_lines.key(x), ())) < 3 or i == max(held[test_lines.key(x)]))) for i, t in rows]


def test_stages_and_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    langs = [r.lang for r in docs.collect()]
    good = {r[0] for r in test_quality.brute(rows, langs) if r[-1]}
    want = [r for r in rows if r[0] in good]
    states = [want]
    states.append(lines_out(states[-1]))
    lowest = {r[2] for r in test_jaccard.brute(states[-1], 5, 80)}
    states.append([r for r in states[-1] if r[0] in lowest])
    states.append([(i, redacted(t)) for i, t in states[-1]])
    got = docs
    for (name, stage), state in zip(corpus_pipeline.STAGES, states):
        got = stage(spark, got, SF).cache()
        assert got.columns == docs.columns, name
        assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(state), name
    for _, t in states[-1]:
        assert not [s for s in base(t) if s[1]] and not re.search(r"(?i)(password|secret|token)\s*[:=]\s*[\"']?\w{6}", t)
    assert test_packing.check(states[-1], corpus_pipeline.run(spark, SF).collect()) > 0.98


def test_odd_rows_and_no_rows(spark):
    for rows in (ODD, []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_columns_that_clash(spark):
    docs = frame(spark, ODD + [(50 + i, "A line that stands in very many documents.\n" + "some words of text " * (20 + i)) for i in range(5)], extra=True)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        if name != "packing":
            assert got.columns == docs.columns, name
        got.collect()
