import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from simforge.llm import tokens
from simforge.llm.tokens import ByteIds, File, file_of, read_documents, tokens_at, widths, write_tokens

from helpers import ODD, SF, frame, sample

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def expected(tok, rows, end=2):
    """(doc_id, start, n_tokens, crc32) by the library alone."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, start, len(ids), zlib.crc32(raw(ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("limit", [1, 2, 16, 17, 256, 4096, 50257, 1 << 20, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_codes(limit, n):
    r = random.Random(n)
    ids = np.array([min(r.randrange(limit), r.randrange(limit)) for _ in range(n)], "<u4")
    f = File(file_of([5, None], [ids[: n // 3].tobytes(), ids[n // 3 :].tobytes()]))
    assert f.doc_ids == [5, None] and f.starts.tolist() == [0, n // 3, n]
    assert f.slice(0, n).tolist() == ids.tolist()
    for _ in range(20):
        a, b = sorted(r.randrange(n + 1) for _ in range(2))
        assert f.slice(a, b).tolist() == ids[a:b].tolist()
    some = [r.randrange(n) for _ in range(50 if n else 0)]
    assert f.at(np.array(some, np.int64)).tolist() == ids[some].tolist()


def test_an_id_is_read_without_its_neighbours():
    """Everything but the chunks of one id may be lost."""
    ids = np.arange(3000, dtype="<u4") * 17
    f = File(file_of([1], [ids.tobytes()]))
    for level in f.levels:
        level.chunks = level.chunks.copy()
    first = f.levels[0]
    keep = 2999 * first.width // 8
    first.chunks[:keep] = 0xFF
    assert f.at(np.array([2999])).tolist() == [2999 * 17]


def test_damage_is_seen():
    whole = bytearray(file_of([1], [raw([1, 2, 3000])]))
    whole[60] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        File(bytes(whole))


def test_widths_take_the_least_room():
    ids = np.array([3] * 900 + [40000] * 100, "<u4")
    assert sum(widths(ids)) == 16 and widths(ids)[0] == 4
    assert widths(np.full(10, 40000, "<u4")) == [16] and widths(np.zeros(0, "<u4")) == [4]


SPACES = [" ", "  ", "   ", "\n", "\n ", " \n", " \n ", "\t", "\xa0", " \xa0 ", "\x1c", " \x85", "\n\n", "\r\n  ", "", "\u2003", "\n\n\n"]
WORDS = ["a", "The", "don't", "señor's", "x²", "½", "3.14", "<|endoftext|>", "y<|endoftext|>z", "'", "'s", "word'", "(x)", "漢字", "αβ", "é", "_", "#$%", "\x00", "ﬁ", "İ", "ß,", "…", "naïve!", "\x01", "a,", "b.)", "5%", "Ünd", "’s", "co-op."]


def test_stretches_give_the_ids_of_whole_texts(tok):
    r, by = random.Random(1), ByteIds(PATH, cached=50)
    assert by.by_stretches
    for _ in range(100):
        batch = ["".join(r.choice(SPACES if i % 2 else WORDS) for i in range(r.randrange(14))) for _ in range(20)]
        assert by.ids(batch) == [raw(tok.encode(t, add_special_tokens=False).ids) for t in batch]


def test_a_file_of_another_kind_encodes_whole_texts():
    by = ByteIds(public_tokenizers.path("word_bpe_49k.json"))
    assert not by.by_stretches
    assert by.ids(["Ab c"]) == [raw(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("Ab c", add_special_tokens=False).ids)]


def test_documents_come_back(spark, tok):
    files = write_tokens(frame(spark, ODD, extra=True), PATH, tokens=100)
    got = [tuple(r) for r in read_documents(files).orderBy("start").collect()]
    assert got == expected(tok, ODD)
    assert files.count() > files.select("part").distinct().count()


def test_order_within_parts(spark):
    files = write_tokens(frame(spark, [(i, f"text {i}") for i in range(300, 0, -1)]), PATH, tokens=50)
    rows = read_documents(files, arrays=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == list(range(1, 301))
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    assert all(zlib.crc32(raw(r.ids)) == r.ids_crc32 for r in rows)


def test_ids_by_position(spark):
    files = write_tokens(frame(spark, sample(spark, 60)), PATH, tokens=3000)
    ids = [i for r in read_documents(files, arrays=True).orderBy("start").collect() for i in r.ids]
    r = random.Random(3)
    asked = [r.randrange(len(ids)) for _ in range(200)] + [0, len(ids) - 1]
    wanted = spark.createDataFrame([(p,) for p in [*asked, -1, len(ids), None]], "position long")
    for span in (1000, 1 << 18):
        assert {x.position: x.id for x in tokens_at(files, wanted, span).collect()} == {p: ids[p] for p in asked}


def test_empty_table(spark):
    assert read_documents(write_tokens(frame(spark, []), PATH)).collect() == []


def test_query(spark, tok):
    got = sorted(tuple(r) for r in tokens.op11_token_codes(spark, SF).collect())
    assert got == sorted(expected(tok, sample(spark)))
