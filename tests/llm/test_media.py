import zlib

from helpers import ODD, frame, sample, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from simforge.llm.media import GEAR, Cuts, chunks, feature, gear, header, media_columns, payload, store, ingest


@given(st.binary(min_size=1, max_size=200))
@settings(max_examples=50, deadline=None)
def test_gear_is_the_rolling_sum(raw):
    h, want = 0, []
    for b in raw:
        h = (h * 2 + int(GEAR[b])) % 2**32
        want.append(h)
    assert gear(raw).tolist() == want


def test_cuts_follow_content():
    import random

    r = random.Random(1)
    a = r.randbytes(300_000)
    small = Cuts(1000, (1 << 10) - 1, 5000)
    assert b"".join(chunks(a, small)) == a and all(len(c) <= 5000 for c in chunks(a, small))
    shared = set(chunks(a, small)) & set(chunks(b"in front" + a, small))
    assert len(shared) > 0.9 * len(chunks(a, small))


def expected(i, text):
    raw = (text or "").encode()
    p = raw + bytes(-len(raw) % 64 if raw else 64)
    assert p == payload(text or "")
    whole = header(len(p)) + p
    return i, len(raw), len(p), sha(p), zlib.crc32(p[-64:]), len(whole), sha(whole), feature(p)


def test_round_trip(spark):
    rows = sample(spark) + [(i and i + 1000, t) for i, t in ODD] + [(2000 + i, "copy " * 9000) for i in range(20)]
    out = media_columns(frame(spark, rows, extra=True), Cuts(500, 255, 3000)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert media_columns(frame(spark, [])).collect() == []


def test_wave_is_readable():
    import io
    import wave

    p = payload("some text")
    w = wave.open(io.BytesIO(header(len(p)) + p))
    assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, p)


def test_store_keeps_a_chunk_once(spark):
    import random

    tail = random.Random(2).randbytes(20_000).hex()
    ingested = ingest(frame(spark, [(1, "x" * 100 + tail), (2, "yy" * 100 + tail)]).repartition(2), Cuts(1000, 1023, 5000))
    lists, chosen = store(ingested)
    assert chosen.count() == 2
    assert lists.select("home_pid", "home_k").distinct().count() == lists.select("digest").distinct().count() < 0.7 * lists.count()


def test_near_copies_and_passages_share_chunks(spark):
    import random

    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(n))
    near, passage = prose(500).split(" "), prose(500)
    rows = [(i, " ".join([*near[: 20 * i], "changed", *near[20 * i :]])) for i in range(20)] + [(100 + i, f"{prose(60)} {passage} {prose(60)}") for i in range(20)]
    ingested = ingest(frame(spark, rows).repartition(4))
    lists, chosen = store(ingested)
    assert chosen.count() == 40
    assert lists.select("digest").distinct().count() < 0.5 * lists.count()
    out = media_columns(frame(spark, rows)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert sorted(map(tuple, out.collect())) == sorted(expected(*x) for x in rows)
