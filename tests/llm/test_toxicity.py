import numpy as np
from helpers import ODD, frame

from simforge.llm.toxicity import Bags, Options, Scorer, features, held_out, op10_toxicity, score, train

O = Options()


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    y = np.array(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_features_share_rows_with_misspellings():
    rows, first = features(["moron", "morom", "x" * 40, "é"], O)
    parts = [set(x.tolist()) for x in np.split(rows, first[1:])]
    assert len(parts[0] & parts[1]) >= 3 and not parts[0] & parts[3]
    assert all(parts)
    again, _ = features(["morom"], O)
    assert set(again.tolist()) == parts[1]


def test_scorer_is_the_mean_of_the_bag():
    table = np.random.default_rng(1).normal(size=1 << O.buckets_log2).astype(np.float32)
    docs = ["one two two three", "", "A b " * 50]
    bags = Bags(docs, O)
    want = [1 / (1 + np.exp(-(float((table[i] * s).sum()) + 0.25))) for i, s in zip(bags.ids, bags.shares)]
    assert np.allclose(Scorer(table, 0.25, O).scores(docs), want, atol=1e-5)


def test_unseen_misspellings():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    docs = [" ".join(rng.choice(plain, 30)) + (" stupidest" if i % 3 == 0 else "") for i in range(600)]
    table, bias = train(docs, [int(i % 3 == 0) for i in range(600)], O)
    s = Scorer(table, bias, O).scores([" ".join(rng.choice(plain, 30)), " ".join(rng.choice(plain, 30)) + " stupidezt"])
    assert s[0] < 0.5 < s[1]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    out = op10_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(held_out(r.doc_id) for r in out)
    assert auc([r.score for r in out], [r.toxic for r in out]) > 0.94


def test_odd_rows(spark):
    table, bias = train(["a"], [0], O)
    got = score(frame(spark, ODD, extra=True), table, bias).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert score(frame(spark, []), *train([], [], O)).collect() == []


def test_no_held_out_row_is_learnt_from(spark, monkeypatch):
    import simforge.llm.toxicity as T

    d, met = "/root/testdata/sf0.1", []
    monkeypatch.setattr(T, "train", lambda texts, toxic, o: met.append((texts, toxic)))
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    T.learn(docs, labels)
    (texts, toxic), texts_of = met[0], {r.doc_id: r.text for r in docs.collect()}
    known = sorted((r.doc_id, texts_of[r.doc_id] or "", r.toxic) for r in labels.collect() if not held_out(r.doc_id) and r.toxic in (0, 1) and r.doc_id in texts_of)
    assert len(known) <= T.Options().sample and sorted(zip(texts, toxic)) == sorted((t, y) for _, t, y in known)
