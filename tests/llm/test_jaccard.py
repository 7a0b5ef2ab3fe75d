import numpy as np
import pytest
from helpers import ODD, WORD, frame, sample
from hypothesis import given, settings
from hypothesis import strategies as st

from simforge.llm.components import components
from simforge.llm.jaccard import Join, RTree, cells, jaccard_components, one_of_each, op9_jaccard_join, prefix, profile, token_ranks, token_sets


def shingles(text, n=4):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n=4, percent=85):
    sets = [shingles(t, n) for _, t in rows]
    at = {}
    for k, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            a, b = root(first.setdefault(i, k)), root(k)
            parent[max(a, b)] = min(a, b)
    for k, s in enumerate(sets):
        if rows[k][0] is None:
            continue
        for m in {m for x in s for m in at[x] if m < k and rows[m][0] is not None}:
            both = len(s & sets[m])
            if 100 * both >= percent * (len(s) + len(sets[m]) - both):
                a, b = root(k), root(m)
                parent[max(a, b)] = min(a, b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(i, low.get(root(k), i))
    return sorted([(i, len(sets[k]), None if i is None else low[root(k)]) for k, (i, _) in enumerate(rows)], key=repr)


def run(df, j=Join()):
    return sorted([tuple(r) for r in jaccard_components(df, j).collect()], key=repr)


def variants():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        text = list(rng.choice(words, 60 + 40 * g))
        for c in range(40):
            own = text[:]
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(len(own)))] = f"x{rng.integers(1000)}"
            rows.append((50_000 + 100 * g + c, " ".join(own)))
    return rows


@pytest.mark.parametrize("small", [64, 4])
def test_against_brute_force(spark, small):
    rows = sample(spark) + variants() + [(i and i + 10_000, t) for i, t in ODD]
    assert run(frame(spark, rows, extra=True), Join(small=small, block=16)) == brute(rows)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op9_jaccard_join(spark, "/root/testdata/sf0.01").collect()], key=repr) == brute(rows)


def test_empty(spark):
    assert run(frame(spark, [])) == []
    assert one_of_each(frame(spark, [])).collect() == []


def test_one_of_each_keeps_the_smallest(spark):
    rows = variants() + [(None, "a row without an id")]
    df = frame(spark, rows)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    want = {c for i, _, c in brute(rows, 5, 80) if i == c}
    assert {r.doc_id for r in kept.collect()} == want


@given(st.integers(1, 120), st.integers(0, 1000))
@settings(max_examples=300, deadline=None)
def test_linked_sets_share_a_bucket(n, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    drop, add = int(rng.integers(0, n // 10 + 1)), int(rng.integers(0, n // 10 + 1))
    b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
    same = len(np.intersect1d(a, b))
    if len(b) and 100 * same >= 85 * (len(a) + len(b) - same):
        for ranks in (np.zeros(1, np.uint8), rng.integers(0, 5, 16).astype(np.uint8)):
            assert np.intersect1d(prefix(a, ranks, 85), prefix(b, ranks, 85)).size


def test_rare_tokens_come_first():
    tokens = np.unique(np.random.default_rng(5).integers(0, 2**63, 200).astype(np.uint64))
    ranks = np.zeros(1 << 16, np.uint8)
    often = tokens[:150]
    ranks[cells(often, len(ranks))] = 9
    assert not np.isin(prefix(tokens, ranks, 85), often).any()


def test_sketch_counts_all_documents(spark):
    rows = sample(spark)
    got, sketches = profile(frame(spark, rows).select("doc_id", "text").fillna(""), Join(cells=1 << 10))
    want = np.zeros(1 << 10, np.int64)
    for s in token_sets([t or "" for _, t in rows]):
        want += np.bincount(cells(s, 1 << 10), minlength=1 << 10)
    assert (token_ranks(sketches, Join(cells=1 << 10)) == np.minimum(4 * np.log2(1 + want), 255).astype(np.uint8)).all()
    assert got.count() == len(rows)


@given(st.integers(1, 90), st.integers(0, 500))
@settings(max_examples=60, deadline=None)
def test_tree_finds_all_that_the_bound_allows(n, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 6, (n, 8))
    sizes = points.sum(1)
    tree = RTree(points, sizes, 4)
    for p, k in zip(points, sizes):
        bound = np.minimum(points, p).sum(1)
        want = np.flatnonzero((185 * bound >= 85 * (k + sizes)) & (100 * np.minimum(k, sizes) >= 85 * np.maximum(k, sizes)))
        assert sorted(tree.search(p, k, 85)) == want.tolist()


def test_tokens():
    assert [len(s) for s in token_sets(["", "a b", "A B c d", "a b c d e", "x x x x x x"])] == [0, 1, 1, 2, 1]
    a, b = token_sets(["The Quick\tbrown\nfox É", "the quick brown fox É"])
    assert (a == b).all()


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component_id for r in components(chain).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
