from collections import Counter

import numpy as np
from helpers import ODD, WORD, frame, same_crc, sample, sha

from simforge.llm.substrings import Windows, Words, counted, op1_substring_dedup, packed, remove_repeated, sliding_min, unpacked


def brute(rows, size=35):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    n = Counter(tuple(w[k : k + size]) for _, w in docs for k in range(len(w) - size + 1))
    out = []
    for i, w in docs:
        gone = {k + d for k in range(len(w) - size + 1) if n[tuple(w[k : k + size])] > 1 for d in range(size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha(kept)))
    return sorted(out, key=repr)


def run(df, o=Windows()):
    return sorted([tuple(r) for r in remove_repeated(df, o).drop("kept").collect()], key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(50)]
    passage = " ".join(rng.choice(words, 60))
    rows = sample(spark) + [(10_000 + i, f"own{i} {passage}\t x{i}") for i in range(30)] + [(i and i + 20_000, t) for i, t in ODD] + [(5, "another text with one id " + passage)]
    assert run(frame(spark, rows, extra=True)) == brute(rows)
    small = Windows(size=5, short=2, subs=2, flush=2000)
    assert run(frame(spark, rows[:150], extra=True), small) == brute(rows[:150], 5)


def test_texts_of_one_id_with_one_crc(spark):
    """A text is known by more than a checksum: the second one stands nowhere else, though another row of its id does."""
    passage = " ".join(f"p{i}" for i in range(45))
    twin, own = same_crc("twin " + passage, " ".join(f"q{i}" for i in range(50)))
    rows = [(1, passage + " here"), (2, twin), (2, own), (3, "short"), (None, own + " x"), (None, "one two")]
    got = run(frame(spark, rows, extra=True))
    assert got == brute(rows)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op1_substring_dedup(spark, "/root/testdata/sf0.01").collect()], key=repr) == brute(rows)


def test_empty(spark):
    assert run(frame(spark, [])) == []


def test_parts():
    x = np.random.default_rng(1).integers(0, 99, 50)
    for n in (1, 2, 3, 7, 8, 32):
        assert sliding_min(x, n).tolist() == [x[i : i + n].min() for i in range(50 - n + 1)]
    assert len(sliding_min(x[:3], 7)) == 0
    strings, counts = unpacked(packed([(b"a b", 2), (b"c", 1)]))
    assert strings == [b"a b", b"c"] and counts.tolist() == [2, 1]
    w = Words(["  é b\t\nc ".encode(), b"", b"d"])
    assert w.bytes == "é b c d ".encode() and w.firsts.tolist() == [0, 3, 3, 4]
    o = Windows(size=2, short=1)
    assert [b for *_, b in counted([packed([(b"a b a b", 1), (b"b c", 1)])], o)] == [bytes([0b101])]
