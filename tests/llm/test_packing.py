import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import ODD, frame, sample
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from simforge.llm.packing import WordIds, packed, places, shortest_pack_first

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK, WORDS = Tokenizer.from_file(PATH), WordIds(PATH)


@given(st.one_of(st.text(), st.text(alphabet="aAbİΣσ  \n\té́.'s<|endoftext|>0½\x1c\x85 ")))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library(text):
    assert np.frombuffer(WORDS.ids([text])[0], "<u4").tolist() == TOK.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300)))
@settings(max_examples=300, deadline=None)
def test_patterns_use_each_piece_once_and_fit(histogram):
    patterns = shortest_pack_first(histogram, 64)
    used = defaultdict(int)
    for p, n in patterns:
        assert sum(size * k for size, k in p) <= 64
        for size, k in p:
            used[size] += k * n
    assert used == histogram
    spans = defaultdict(list)
    for size, lo, hi, *_ in places(patterns):
        spans[size].append((lo, hi))
    for size, s in spans.items():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] == histogram[size] and all(a[1] == b[0] for a, b in zip(s, s[1:]))


def check(rows, out):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    by = defaultdict(list)
    for i, t in rows:
        by[i].append(np.array([*TOK.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    assert set(docs) == set(by)
    for i, all_ids in by.items():
        if len(all_ids) == 1:
            at, ids = 0, all_ids[0]
            for r in sorted(docs[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(r.length for r in out) / (2048 * max(1, len(sequences)))


def test_frame(spark):
    rows = sample(spark) + [(i and i + 1000, t) for i, t in ODD]
    full = check(rows, packed(frame(spark, rows, extra=True), PATH).collect())
    assert full > 0.97
    assert packed(frame(spark, []), PATH).collect() == []


def test_words_encoded_together_equal_words_alone():
    words = sorted({w.strip(".,").lower() for w in "The quick brown foxes, ñandú straße ΣΊΣΥΦΟΣ naïve éclair ⅷ ª ǅ 漢字 한국어 हिन्दी".split()} | {"a" * 3000})
    got = WORDS.ids([" ".join(words)])[0]
    assert np.frombuffer(got, "<u4").tolist() == TOK.encode(" ".join(words), add_special_tokens=False).ids
    fresh = WordIds(PATH)
    for w in words:
        assert np.frombuffer(fresh.ids([w])[0], "<u4").tolist() == TOK.encode(w, add_special_tokens=False).ids
        assert fresh.ids([w]) == WORDS.ids([w])
