import numpy as np
import pytest
from helpers import ODD, frame, same_crc, sample, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from simforge.llm.suffixes import Run, Strings, anchors, common, decoded, merged, op3_suffix_dedup, remove_later_copies


def brute(rows, size=50):
    low = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for k in range(len(raw) - size + 1):
                s = raw[k : k + size]
                low[s] = min(i, low.get(s, i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, np.int64)
        if i is not None:
            for k in range(len(raw) - size + 1):
                if low[raw[k : k + size]] < i:
                    gone[k] += 1
                    gone[k + size] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(mask.sum()), spans, sha(np.frombuffer(raw, np.uint8)[~mask].tobytes())))
    return sorted(out, key=repr)


def run(df, o=Strings()):
    return sorted([tuple(r) for r in remove_later_copies(df, o).drop("kept").collect()], key=repr)


def made():
    rng = np.random.default_rng(11)
    letters = list("abcde fgh")
    passage = "".join(rng.choice(letters, 90))
    rows = [(40_000 + i, f"own {i} " + "".join(rng.choice(letters, 30)) + passage[i % 7 :] + "".join(rng.choice(letters, 80))) for i in range(40)]
    near = list("".join(rng.choice(letters, 300)))
    for i in range(30):
        own = near[:]
        own[int(rng.integers(300))] = "Z"
        rows.append((41_000 + i, "".join(own)))
    return rows + [(42_000 + i, "copy of a text that is long enough to be a window of its own " * 3) for i in range(5)]


@pytest.mark.parametrize("many", [100_000, 3])
def test_against_brute_force(spark, many):
    rows = sample(spark, 80) + made() + [(i and i + 20_000, t) for i, t in ODD] + [(5, "second text of one id " * 9)]
    assert run(frame(spark, rows, extra=True), Strings(ranges=3, flush=20_000, sample=20, many=many)) == brute(rows)


def test_texts_of_one_id_with_one_crc(spark):
    """A copy of an earlier text goes, another text of its id with its checksum stays."""
    twin, own = same_crc("a text that an earlier document has as well " * 3, "a text that stands nowhere else but here, whatever its id " * 3)
    rows = [(1, twin), (2, twin), (2, own), (2, "third " * 20), (3, own[:70]), (None, own), (None, "no id")]
    got = run(frame(spark, rows, extra=True))
    assert got == brute(rows)
    assert (2, len(own), 0, 0, sha(own)) in got


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op3_suffix_dedup(spark, d).collect()], key=repr) == brute(rows)


def test_empty(spark):
    assert run(frame(spark, [])) == []


@given(st.lists(st.lists(st.text(alphabet="ab", max_size=6).map(str.encode), max_size=8), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    shared = [[0, *(common(a, b) for a, b in zip(r, r[1:]))][: len(r)] for r in runs]
    got = [(runs[r][i], h) for r, i, h in merged(runs, shared)]
    want = sorted(x for r in runs for x in r)
    assert [x for x, _ in got] == want
    assert [h for _, h in got] == [0, *(common(a, b) for a, b in zip(want, want[1:]))][: len(want)]


def test_runs_round_trip():
    r = Run()
    r.add([(3, 7, b"some text of more than fifty bytes that is repeated; " * 4), (2, 9, b"short")], 50)
    ranges, blobs = r.blobs(np.zeros(0, np.uint64))
    suffixes, shared, before, ids, ths, first = decoded(blobs[0])
    raw = b"some text of more than fifty bytes that is repeated; " * 4
    assert suffixes == sorted(suffixes) and set(ids) == {3} and set(ths) == {7}
    assert all(raw[f : f + len(b) + len(s)] == b + s for b, s, f in zip(before, suffixes, first))


def test_long_texts_in_pieces_have_the_same_windows():
    raw = np.frombuffer(np.random.default_rng(4).bytes(5000), np.uint8) % 7
    ends = np.array([1300, 1310, 5000])
    cover = lambda most: {(w, p) for f, e, p in zip(*anchors(raw, ends, 50, most)) for w in range(f, e - 49)}
    assert cover(1 << 20) == cover(700) and len(cover(700)) == 1300 - 49 + 3690 - 49
