"""Removal of repeated word sequences by super-k-mer partitioning.

A window is `size` consecutive words of a document. Its minimiser is the least
hash of the short word sequences in it. Consecutive windows with one minimiser
travel together as one packed string, a super-k-mer, to the bucket that the
minimiser names; equal windows have equal minimisers, so they meet there. In a
bucket all windows are sorted by hash, neighbours are compared word for word,
and counts of equal ones are summed.

A task sends each super-k-mer once with its count, whatever the number of its
copies. The bucket answers with the windows of a super-k-mer that occur
elsewhere, under a digest of its string; places of super-k-mers in documents are
joined to that, a join that Spark can split where one string has very many
places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, freed, partitions, small_batches, written

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: A random number for each byte, by a fixed seed.
BYTE = np.random.default_rng(35).integers(1, 2**64, 256, dtype=U)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class Windows:
    """size: words to a window. short: words to the sequences that minimisers come from. subs: buckets for each shuffle partition. flush: bytes of text whose super-k-mers a task gathers before it sends them."""

    size: int = 35
    short: int = 4
    subs: int = 16
    flush: int = 24 << 20


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        return h ^ (h >> U(32))


class Words:
    """The words of some texts, with single spaces between: bytes, where each word begins and ends, a hash of each, and each text's first word."""

    def __init__(self, raws: list[bytes]):
        raw = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        blank = BLANK[raw]
        inside = ~blank
        first = inside & np.concatenate([[True], blank[:-1]])
        end = blank & np.concatenate([[False], inside[:-1]])
        starts = np.flatnonzero(first)
        self.sizes = np.flatnonzero(end) - starts
        kept = raw[inside | end].copy()
        at = np.cumsum(self.sizes + 1)
        if len(at):
            kept[at - 1] = 32
        self.bytes = kept.tobytes()
        self.ends = at - 1
        self.starts = self.ends - self.sizes
        self.firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])) if raws else np.zeros(1, np.int64)
        with np.errstate(over="ignore"):
            letters = BYTE[raw[inside]]
            begin = np.cumsum(self.sizes) - self.sizes
            powers = np.cumprod(np.full(int(self.sizes.max(initial=1)), BASE, U))
            place = np.arange(len(letters)) - np.repeat(begin, self.sizes)
            self.hashes = mix(np.add.reduceat(letters * powers[place], begin) + self.sizes.astype(U)) if len(starts) else np.zeros(0, U)

    def sequences(self, n: int) -> np.ndarray:
        """A hash of the n words from each word on; those that leave a text are of no use."""
        with np.errstate(over="ignore"):
            m = max(0, len(self.hashes) - n + 1)
            out = self.hashes[:m].copy()
            for k in range(1, n):
                out = out * BASE + self.hashes[k : m + k]
            return mix(out)

    def valid(self, n: int) -> np.ndarray:
        """Whether n words from each word on lie in one text."""
        last = np.repeat(self.firsts[1:], np.diff(self.firsts))
        return np.arange(len(self.hashes)) + n <= last


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of n numbers from each place on, by doubling spans."""
    span, out = 1, x
    while span * 2 <= n:
        out = np.minimum(out[:-span], out[span:]) if len(out) > span else out[:0]
        span *= 2
    return np.minimum(out[: len(out) - (n - span)], out[n - span :]) if n > span and len(out) > n - span else out if n == span else out[:0]


def super_kmers(w: Words, o: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each run of windows of one text with one minimiser."""
    least = sliding_min(w.sequences(o.short), o.size - o.short + 1)
    ok = w.valid(o.size)[: len(least)]
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    new = ok & np.concatenate([[True], ~ok[:-1] | (least[1:] != least[:-1])])
    first = np.flatnonzero(new)
    where = np.flatnonzero(ok)
    count = np.diff(np.append(np.searchsorted(where, first), len(where)))
    return first, count, least[first]


def strings(w: Words, first: np.ndarray, count: np.ndarray, o: Windows) -> list[bytes]:
    b = w.bytes
    return [b[s:e] for s, e in zip(w.starts[first].tolist(), w.ends[first + count + o.size - 2].tolist())]


def key_of(s: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(s, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def packed(items: list[tuple[bytes, int]], level: int = 3) -> bytes:
    import zstandard

    n = np.array([len(items), *(len(s) for s, _ in items), *(c for _, c in items)], "<u4")
    return zstandard.ZstdCompressor(level=level).compress(n.tobytes() + b"".join(s for s, _ in items))


def unpacked(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes, counts = np.frombuffer(raw, "<u4", n, 4).astype(np.int64), np.frombuffer(raw, "<u4", n, 4 + 4 * n).astype(np.int64)
    ends = 4 + 8 * n + np.cumsum(sizes)
    return [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())], counts


def send(docs: DataFrame, o: Windows) -> DataFrame:
    """bucket, blob: packed super-k-mers with counts."""
    small_batches(docs.sparkSession)
    buckets = U(o.subs * partitions(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            by: dict[int, list[tuple[bytes, int]]] = {}
            for s, (b, n) in held.items():
                by.setdefault(b, []).append((s, n))
            return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array([packed(x) for x in by.values()], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            raws = [t.encode() for t in batch.column(2).to_pylist()]
            w = Words(raws)
            first, count, least = super_kmers(w, o)
            for s, b in zip(strings(w, first, count, o), (mix(least) % buckets).astype(np.int64).tolist()):
                x = held.get(s)
                if x is None:
                    held[s] = [b, 1]
                else:
                    x[1] += 1
            size += sum(map(len, raws))
            if size >= o.flush:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return docs.mapInArrow(freed(run), "bucket long, blob binary")


def counted(blobs: list[bytes], o: Windows) -> Iterator[tuple[int, int, bytes]]:
    """(key, key, bits of its windows that occur twice or more) of each super-k-mer in a bucket that has such windows."""
    total: dict[bytes, int] = {}
    for blob in blobs:
        for s, c in zip(*unpacked(blob)):
            total[s] = total.get(s, 0) + int(c)
    items = list(total)
    w = Words(items)
    h = np.zeros(0, U)
    ok = np.flatnonzero(w.valid(o.size))
    h = w.sequences(o.size)[ok]
    per = np.diff(w.firsts) - o.size + 1
    owner = np.repeat(np.arange(len(items)), per)
    counts = np.repeat(np.fromiter(total.values(), np.int64, len(items)), per)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    new = np.concatenate([[True], hs[1:] != hs[:-1]])
    # Neighbours with one hash are compared word for word. Were they to differ, their run would be parted.
    same = np.flatnonzero(~new)
    b, starts, ends = w.bytes, w.starts[ok], w.ends[ok + o.size - 1]
    x, y = order[same - 1], order[same]
    differ = [k for k, s, e, t, f in zip(same.tolist(), starts[x].tolist(), ends[x].tolist(), starts[y].tolist(), ends[y].tolist()) if b[s:e] != b[t:f]]
    run = np.cumsum(new) - 1
    sums = np.bincount(run, counts[order])
    twice = np.zeros(len(h), bool)
    twice[order] = sums[run] >= 2
    for r in {int(run[k]) for k in differ}:  # distinct windows of one 64-bit hash
        inside = order[run == r]
        exact: dict[bytes, int] = {}
        for i in inside:
            exact[b[starts[i] : ends[i]]] = exact.get(b[starts[i] : ends[i]], 0) + int(counts[i])
        twice[inside] = [exact[b[starts[i] : ends[i]]] >= 2 for i in inside]
    edges = np.concatenate([[0], np.cumsum(per)])
    for k in np.unique(owner[twice]).tolist():
        yield *key_of(items[k]), np.packbits(twice[edges[k] : edges[k + 1]], bitorder="little").tobytes()


def repeated(sent: DataFrame, o: Windows) -> DataFrame:
    """k1, k2, bits: super-k-mers with windows that occur elsewhere. Blobs come sorted by bucket; a task holds one bucket."""
    ordered = sent.repartition(partitions(sent.sparkSession), "bucket").sortWithinPartitions("bucket")
    small_batches(sent.sparkSession, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(blobs: list[bytes]) -> pa.RecordBatch:
            rows = list(counted(blobs, o))
            k1, k2, bits = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.binary())], ["k1", "k2", "bits"])

        now, blobs = None, []
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now and blobs:
                    yield answer(blobs)
                    blobs = []
                now = k
                blobs.append(blob)
        if blobs:
            yield answer(blobs)

    return ordered.mapInArrow(freed(run), "k1 long, k2 long, bits binary")


def places(docs: DataFrame, o: Windows) -> DataFrame:
    """k1, k2, id, at: each super-k-mer of each document. at holds the number of the row's text (th) above its first window."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words([t.encode() for t in batch.column(2).to_pylist()])
            first, count, _ = super_kmers(w, o)
            keys = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in strings(w, first, count, o)), "<i8").reshape(-1, 2)
            doc = np.searchsorted(w.firsts, first, "right") - 1
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = (ths[doc] << 32) | (first - w.firsts[doc]) if len(doc) else np.zeros(0, np.int64)
            for a in range(0, len(doc), 50_000):
                z = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[z, 0]), pa.array(keys[z, 1]), pa.array(ids[doc[z]]), pa.array(at[z])], ["k1", "k2", "id", "at"])

    return docs.mapInArrow(freed(run), "k1 long, k2 long, id long, at long")


def keyed(docs: DataFrame) -> DataFrame:
    """id, th, text, doc_id: id and th name a row. id is its doc_id, or 64 bits of the text of a row without one; th numbers the different texts of an id, by SHA-256, from 0.

    Where every id has one row, which takes a look at ids alone, th is 0 everywhere.
    Otherwise the ids that have several are numbered, and their texts' digests joined.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ids = rows.where("doc_id is not null").select(F.col("doc_id").alias("id")).unionByName(rows.where("doc_id is null").select(F.xxhash64("text").alias("id")))
    several = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    k = rows.select(F.coalesce("doc_id", F.xxhash64("text")).alias("id"), "text", "doc_id")
    if several.isEmpty():
        return k.select("id", F.lit(0).cast("long").alias("th"), "text", "doc_id")
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    texts = k.join(several, "id", "left_semi").select("id", digest).distinct()
    number = F.row_number().over(Window.partitionBy("id").orderBy("digest")) - 1
    numbered = written(texts.withColumn("_th", number.cast("long")), "keyed-texts")
    return k.withColumn("digest", digest).join(numbered, ["id", "digest"], "left").select("id", F.coalesce("_th", F.lit(0).cast("long")).alias("th"), "text", "doc_id")


def squeezed(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(t.encode()) for t in b.column(2).to_pylist()], pa.binary()), b.column(3)], ["id", "th", "z", "doc_id"])

    return docs.mapInArrow(freed(run), "id long, th long, z binary, doc_id long")


def remove_repeated(docs: DataFrame, o: Windows = Windows(), with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept (else null): one row for each row of docs.

    A null or empty text has no words. Documents under a window lose nothing. Rows
    that agree in doc_id and text are copies of each other, so all of their windows
    repeat. The most that a task holds is a bucket, a flush of super-k-mers, or a document.
    """
    k = keyed(docs)
    slim = k.select("id", "th", "text")
    found = written(repeated(send(slim, o), o), "substring-repeated")
    hits = places(slim, o).join(found, ["k1", "k2"]).select("id", F.shiftright("at", 32).alias("th"), F.struct(F.col("at").bitwiseAND(0xFFFFFFFF).alias("at"), "bits").alias("hit"))
    hits = hits.groupBy("id", "th").agg(F.collect_list("hit").alias("hits"))
    both = squeezed(k).join(hits, ["id", "th"], "left").select("doc_id", "z", "hits")
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        un = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for z, hits in zip(b.column(1).to_pylist(), b.column(2)):
                w = Words([un.decompress(z)])
                n = len(w.hashes)
                gone = np.zeros(n + 1, np.int64)
                for hit in hits.as_py() or ():
                    bits = np.flatnonzero(np.unpackbits(np.frombuffer(hit["bits"], np.uint8), bitorder="little")) + hit["at"]
                    np.add.at(gone, bits, 1)
                    np.add.at(gone, bits + o.size, -1)
                keep = np.flatnonzero(np.cumsum(gone[:n]) <= 0)
                kept = w.bytes[:-1] if len(keep) == n else b" ".join([w.bytes[s:e] for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist())])
                rows.append((n, n - len(keep), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))]], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return both.mapInArrow(freed(run), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op1_substring_dedup(spark, sf_dir):
    return remove_repeated(documents(spark, sf_dir), with_text=False).drop("kept")
