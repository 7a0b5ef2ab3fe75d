"""Media columns by content-defined chunking.

A text's bytes are stored as 8-bit mono samples behind a WAVE header. The
samples are cut where a rolling gear hash of the last 32 bytes has its low bits
clear, so equal stretches of different media give equal chunks. Chunks that a
task hasn't met are packed together, some hundreds to a pack, which packs them
far better than one by one. A Spark join on their digests gives every chunk one
home among the packs. A medium is an ordered list of chunks; it is put together
from their homes and verified by its own digest before anything is computed from
it. Packs answer for the media that lie in them alone, and send the few chunks
that media elsewhere want.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, freed, release, small_batches, texts, written

RATE = 8000
#: Bytes of a SHA-256 that media and chunks are known by.
KEY = 16
#: A random number for each byte value, by a fixed seed.
GEAR = np.random.default_rng(2024).integers(0, 2**32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class Cuts:
    """Chunks of some 1400 bytes, less than a usual text: so near copies and passages are shared, and not only whole copies. pack: bytes of chunks to a pack."""

    least: int = 400
    mask: int = (1 << 10) - 1
    most: int = 8 << 10
    pack: int = 768 << 10


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


def header(n: int) -> bytes:
    """Of a WAVE file with n 8-bit samples of one channel."""
    return b"RIFF" + struct.pack("<I", 36 + n & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n & 0xFFFFFFFF)


def gear(raw: bytes) -> np.ndarray:
    """The rolling hash at each byte: sum of GEAR of the last 32 bytes, each doubled once for each byte since. Six doublings of the span make it."""
    h = GEAR[np.frombuffer(raw, np.uint8)]
    span = 1
    while span < 32:
        h = h.copy()
        h[span:] += h[:-span] << np.uint32(span) if span < len(h) else h[:0]
        span *= 2
    return h


def chunks(raw: bytes, c: Cuts = Cuts()) -> list[bytes]:
    """raw in order, cut by content. Nothing gives one empty chunk."""
    if len(raw) <= c.least:
        return [raw]
    marks = np.flatnonzero(gear(raw) >> np.uint32(19) & np.uint32(c.mask) == 0) + 1
    out, at = [], 0
    while len(raw) - at > c.least:
        i = np.searchsorted(marks, at + c.least)
        end = min(int(marks[i]) if i < len(marks) else len(raw), at + c.most, len(raw))
        out.append(raw[at:end])
        at = end
    if at < len(raw):
        out.append(raw[at:])
    return out


def feature(raw: bytes) -> str:
    """Samples, mean, deviation, crossings of the middle, peak: integers and their quotients, so equal on every machine."""
    x = np.frombuffer(raw, np.uint8).astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    mean = total * 10**6 // n
    variance = (squares * n - total * total) * 10**6 // (n * n)
    return f"samples={n};mean_e6={mean};var_e6={variance};crossings={int((np.diff((x >= 128).astype(np.int8)) != 0).sum())};peak={int(x.max())}"


#: kind doc: a document and its medium. medium: one that a pack lists, its m-th. chunk: the seq-th of that medium, at k in the pack, null if it isn't there. pack: the chunks, and for each medium of the pack its digest (media), number of chunks and their k (plan, -1: elsewhere).
STORED = "kind string, doc_id long, n_bytes long, media binary, pid long, m int, seq int, k int, n_chunks int, digest binary, blob binary, sizes binary, plan binary"
KINDS = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
NAMES = [c.split()[0] for c in STORED.split(", ")]


def table(rows: list[dict], names: list[str], kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds)], names)


def ingest(docs: DataFrame, c: Cuts = Cuts(), level: int = 9) -> DataFrame:
    """The written table of documents, media, chunks and packs. A chunk that its task has met is in an earlier pack and not stored again."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        pid = (task.partitionId() if task else 0) << 32
        seen: set[bytes] = set()
        parts: list[bytes] = []
        here: dict[bytes, int] = {}
        media: list[bytes] = []
        plan: list[np.ndarray] = []
        held = 0

        def pack() -> dict:
            sizes = np.array([len(x) for x in parts], "<u4").tobytes()
            counts = np.array([len(x) for x in plan], "<i4").tobytes()
            return {"kind": "pack", "pid": pid, "media": b"".join(media), "n_chunks": len(media), "blob": bz2.compress(b"".join(parts), level), "sizes": sizes, "plan": counts + b"".join(x.tobytes() for x in plan)}

        for b in batches:
            rows: list[dict] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = payload(text)
                key = hashlib.sha256(header(len(raw)) + raw).digest()[:KEY]
                rows.append({"kind": "doc", "doc_id": doc, "n_bytes": len(text.encode()), "media": key})
                if key in seen:
                    continue
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(key)
                cut, own = chunks(raw, c), []
                for seq, part in enumerate(cut):
                    digest = hashlib.sha256(part).digest()[:KEY]
                    k = here.get(digest)
                    if digest not in seen:
                        seen.add(digest)
                        k = here[digest] = len(parts)
                        parts.append(part)
                        held += len(part)
                    own.append(-1 if k is None else k)
                    rows.append({"kind": "chunk", "pid": pid, "m": len(media), "seq": seq, "k": k, "digest": digest})
                rows.append({"kind": "medium", "pid": pid, "m": len(media), "media": key})
                media.append(key)
                plan.append(np.array(own, "<i4"))
                if held >= c.pack or len(media) >= 1000:
                    rows.append(pack())
                    pid, held, parts, here, media, plan = pid + 1, 0, [], {}, [], []
            yield table(rows, NAMES, KINDS)
        if media:
            yield table([pack()], NAMES, KINDS)

    return written(texts(docs).mapInArrow(freed(run), STORED), "media", "none")


def homes(ingested: DataFrame) -> DataFrame:
    """digest, home_pid, home_k: the one place that each chunk is read from, whatever the number of packs that have it."""
    own = ingested.where("kind = 'chunk' and k is not null")
    return own.groupBy("digest").agg(F.min(F.struct("pid", "k")).alias("home")).select("digest", F.col("home.pid").alias("home_pid"), F.col("home.k").alias("home_k"))


def store(ingested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk lists: pid, m, seq, digest, k, home_pid, home_k of the media that count; chosen: pid, m, media). Of packs that list one medium, the first does; chunk digests are joined to their homes."""
    chosen = ingested.where("kind = 'medium'").groupBy("media").agg(F.min(F.struct("pid", "m")).alias("at")).select(F.col("at.pid").alias("pid"), F.col("at.m").alias("m"), "media")
    entries = ingested.where("kind = 'chunk'").select("pid", "m", "seq", "digest", "k")
    return entries.join(homes(ingested), "digest"), chosen


BACK = "kind string, media binary, seq int, n_chunks int, digest binary, part binary, payload_bytes long, payload binary, tail_crc32 long, media_bytes long, rest binary, feature string"
BACK_KINDS = (pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string())
BACK_NAMES = [c.split()[0] for c in BACK.split(", ")]


def computed(media: bytes, raw: bytes) -> dict:
    """What is computed of a medium that was read back. One that differs from its digest ends the job."""
    whole = header(len(raw)) + raw
    sha = hashlib.sha256(whole).digest()
    if sha[:KEY] != media:
        raise ValueError(f"medium {media.hex()} doesn't come back from the store as it was")
    samples = whole[44:]
    return {"kind": "done", "media": media, "payload_bytes": len(samples), "payload": hashlib.sha256(samples).digest(), "tail_crc32": zlib.crc32(samples[-64:]), "media_bytes": len(whole), "rest": sha[KEY:], "feature": feature(samples)}


def read_back(ingested: DataFrame) -> DataFrame:
    """media and what is computed of each medium, read from the homes of its chunks.

    Each pack meets what is asked of it: which of its media count, which of their
    chunks live elsewhere, and which of its own chunks others want. It computes the
    media that it has alone, and passes on the parts of the rest, which are gathered
    by medium. A chunk that very many media want is one row that is joined to them.
    """
    spark = ingested.sparkSession
    lists, chosen = store(ingested)
    away = lists.where("home_pid != pid")
    none = lambda kind: F.lit(None).cast(kind)
    ask = lambda df, pid, what, m, seq, k, digest: df.select(F.col(pid).alias("pid"), F.struct(F.lit(what).alias("what"), m.alias("m"), seq.alias("seq"), k.alias("k"), digest.alias("digest")).alias("ask"))
    asked = ask(chosen, "pid", 0, F.col("m"), none("int"), none("int"), none("binary"))
    asked = asked.unionByName(ask(away, "pid", 1, F.col("m"), F.col("seq"), none("int"), F.col("digest")))
    wanted = away.join(chosen.select("pid", "m"), ["pid", "m"], "left_semi").select("home_pid", "home_k", "digest").distinct()
    asked = asked.unionByName(ask(wanted, "home_pid", 2, none("int"), none("int"), F.col("home_k"), F.col("digest")))
    packs = ingested.where("kind = 'pack'").select("pid", "media", "n_chunks", "blob", "sizes", "plan")
    small_batches(spark, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for media, n, blob, sizes, plan, asks in zip(*[b.column(i) for i in range(1, 7)]):
                raw, media, plan = bz2.decompress(blob.as_py()), media.as_py(), np.frombuffer(plan.as_py(), "<i4")
                at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes.as_py(), "<u4").astype(np.int64))]).tolist()
                part = lambda k: raw[at[k] : at[k + 1]]  # noqa: E731, B023
                counts = plan[: n.as_py()]
                starts = (n.as_py() + np.concatenate([[0], np.cumsum(counts)])).tolist()
                rows, counted, elsewhere = [], [], {}
                for x in asks.as_py():
                    if x["what"] == 0:
                        counted.append(x["m"])
                    elif x["what"] == 1:
                        elsewhere.setdefault(x["m"], {})[x["seq"]] = x["digest"]
                    else:
                        rows.append({"kind": "chunk", "digest": x["digest"], "part": part(x["k"])})
                for m in counted:
                    key, own, far = media[KEY * m : KEY * m + KEY], plan[starts[m] : starts[m + 1]].tolist(), elsewhere.get(m)
                    if not far:
                        rows.append(computed(key, b"".join(map(part, own))))
                        continue
                    for seq, k in enumerate(own):
                        rows.append({"kind": "want", "media": key, "seq": seq, "n_chunks": len(own), "digest": far[seq]} if seq in far else {"kind": "part", "media": key, "seq": seq, "n_chunks": len(own), "part": part(k)})
                yield table(rows, BACK_NAMES, BACK_KINDS)

    # The shuffles of digests go before packs are shuffled, and those of packs before parts are. What is asked grows with the documents, so it isn't broadcast.
    asked = written(asked.groupBy("pid").agg(F.collect_list("ask").alias("asks")), "media-asked")
    release(spark)
    joined = packs.join(asked.hint("merge"), "pid").select("pid", "media", "n_chunks", "blob", "sizes", "plan", "asks")
    back = written(joined.mapInArrow(freed(run), BACK), "media-back")
    discard(asked)
    release(spark)
    results = [c for c in BACK_NAMES if c not in ("kind", "seq", "n_chunks", "digest", "part")]
    done = back.where("kind = 'done'").select(*results)
    sent = back.where("kind = 'want'").select("media", "seq", "n_chunks", "digest").join(back.where("kind = 'chunk'").select("digest", "part"), "digest").select("media", "seq", "n_chunks", "part")
    gathered = back.where("kind = 'part'").select("media", "seq", "n_chunks", "part").unionByName(sent).groupBy("media").agg(F.first("n_chunks").alias("n_chunks"), F.sort_array(F.collect_list(F.struct("seq", "part"))).alias("parts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = results
        kinds = [BACK_KINDS[BACK_NAMES.index(c)] for c in names]
        for b in batches:
            rows = []
            for key, n, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = [p["part"] for p in parts.as_py()]
                if len(found) != n:
                    raise ValueError(f"medium {key.hex()} lacks chunks")
                rows.append(computed(key, b"".join(found)))
            yield table(rows, names, kinds)

    rest = gathered.mapInArrow(freed(finish), ", ".join(c for c in BACK.split(", ") if c.split()[0] in results))
    return done.unionByName(rest)


def media_columns(docs: DataFrame, c: Cuts = Cuts()) -> DataFrame:
    """doc_id, n_bytes and what the medium of each row gives when read back from the chunk store.

    A null or empty text is 64 zero samples. Equal texts share a medium, which is
    read back once, and get equal values; a medium on very many rows is joined to
    them as a skewed key. A task holds some packs, or one medium's chunks, besides an Arrow batch.
    """
    ingested = ingest(docs, c)
    rows = ingested.where("kind = 'doc'").select("doc_id", "n_bytes", "media")
    digest = lambda c: F.lower(F.hex(c))  # noqa: E731  digests travel as 32 bytes
    return rows.join(read_back(ingested), "media").select("doc_id", "n_bytes", "payload_bytes", digest("payload").alias("payload_sha256"), "tail_crc32", "media_bytes", digest(F.concat("media", "rest")).alias("media_sha256"), "feature")


def op2_media(spark, sf_dir):
    return media_columns(documents(spark, sf_dir))
