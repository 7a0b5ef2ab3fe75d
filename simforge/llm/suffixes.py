"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Suffixes are taken where a 50-byte window has its least hash of 16 bytes: equal
windows have it at the same place, so of two equal windows the suffixes from
there on agree up to the windows' end, and the bytes in front of them agree
back to the windows' start. About one suffix in eighteen is enough for all
windows, and each of them carries the bytes that its windows have in front.

A task sorts the suffixes of some texts, parts them at splitters, and sends
each range as a front-coded run: the length of the prefix that a suffix shares
with the one before it, and the rest. A loser tree merges the runs of a range.
It keeps for each run the length of the prefix that its head shares with the
last winner: of two heads the one that shares more is the smaller, and only
heads that share equally much are compared, from there on. The lengths tell
where neighbours stop agreeing in 16 bytes, so the groups in which equal
windows meet come out of the merge itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, freed, partitions, release, small_batches, written
from .substrings import BASE, BYTE, U, keyed, mix, sliding_min, squeezed

GRAM = 16
LOW = U((1 << 24) - 1)


@dataclass(frozen=True)
class Strings:
    """size: bytes to a window. ranges: for each shuffle partition. flush: bytes of text to a run. sample: documents that splitters are chosen from; they decide on balance alone. many: places of a string from which they are settled by a join."""

    size: int = 50
    ranges: int = 16
    flush: int = 16 << 20
    sample: int = 2000
    many: int = 100_000


def anchors(raw: np.ndarray, ends: np.ndarray, size: int, most: int = 8 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end of the last window, suffix) of each run of windows with one suffix. ends: of the texts in raw."""
    if len(raw) < size:
        return (np.zeros(0, np.int64),) * 3
    if len(raw) > most + size - 1:  # places must fit below the hash
        parts = [(s, anchors(raw[s : s + most + size - 1], np.clip(ends - s, 0, min(most + size - 1, len(raw) - s)), size, most)) for s in range(0, len(raw) - size + 1, most)]
        return tuple(np.concatenate([p[k] + s for s, p in parts]) for k in range(3))
    with np.errstate(over="ignore"):
        h, power, span = BYTE[raw], BASE, 1
        while span < 4:
            h = h[:-span] * power + h[span:]
            power, span = power * power, span * 2
        four, more = h, power
        while span < GRAM:
            h = h[: len(four) - span] * more + four[span:]
            span += 4
        h = (mix(h) & ~LOW) | np.arange(len(h), dtype=U)
    least = sliding_min(h, size - GRAM + 1)
    stop = np.repeat(ends, np.diff(ends, prepend=0))[: len(least)]
    ok = np.arange(len(least)) + size <= stop
    at = (least & LOW).astype(np.int64)
    new = ok & np.concatenate([[True], ~ok[:-1] | (at[1:] != at[:-1])])
    first, where = np.flatnonzero(new), np.flatnonzero(ok)
    count = np.diff(np.append(np.searchsorted(where, first), len(where)))
    return first, first + count - 1 + size, at[first]


def heads(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first bytes from each place on, as rows."""
    return raw[at[:, None] + np.arange(GRAM)]


def common(a: bytes, b: bytes, h: int = 0) -> int:
    """The length of the common prefix, known to be h or more."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    while a[h] == b[h]:
        h += 1
    return h


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers, all lowest bytes first and so on, which leaves long runs of zeros."""
    return np.ascontiguousarray(x.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


class Run:
    """The suffixes of some texts, to be sorted and front-coded."""

    def __init__(self):
        self.raws, self.docs, self.parts, self.base = [], [], [], 0

    def add(self, docs: list[tuple[int, int, bytes]], size: int) -> None:
        """docs: id, text hash, text."""
        at = self.base
        for i, th, raw in docs:
            self.docs.append((i, th, at))
            at += len(raw)
        whole = b"".join([raw for *_, raw in docs])
        first, end, place = anchors(np.frombuffer(whole, np.uint8), np.cumsum([len(raw) for *_, raw in docs]) if docs else np.zeros(0, np.int64), size)
        self.raws.append(whole)
        self.parts.append((first + self.base, end + self.base, place + self.base))
        self.base += len(whole)

    def blobs(self, splitters: np.ndarray) -> tuple[list[int], list[bytes]]:
        """(range, front-coded run) pairs."""
        import zstandard

        buf = b"".join(self.raws)
        first, end, at = (np.concatenate(x) for x in zip(*self.parts))
        if not len(at):
            return [], []
        rows = heads(np.frombuffer(buf, np.uint8), at)
        high = np.ascontiguousarray(rows[:, :8]).view(">u8")[:, 0].astype(U)
        order = np.lexsort((np.ascontiguousarray(rows[:, 8:]).view(">u8")[:, 0], high))
        rows, high = rows[order], high[order]
        unlike = rows[1:] != rows[:-1]
        lcp = np.concatenate([[0], np.where(unlike.any(1), unlike.argmax(1), GRAM)])
        tie = np.flatnonzero(np.diff(np.concatenate([[0], (lcp == GRAM).astype(np.int8), [0]])))
        for s, e in zip((tie[::2] - 1).tolist(), tie[1::2].tolist()):
            own = sorted((buf[a:z], i) for a, z, i in zip(at[order[s:e]].tolist(), end[order[s:e]].tolist(), order[s:e].tolist()))
            order[s:e] = [i for _, i in own]
            lcp[s + 1 : e] = [common(x, y, GRAM) for (x, _), (y, _) in zip(own, own[1:])]
        first, end, at = first[order], end[order], at[order]
        starts = np.array([d[2] for d in self.docs], np.int64)
        doc = np.searchsorted(starts, first, "right") - 1
        ids, ths = np.array([d[0] for d in self.docs], "<i8"), np.array([d[1] for d in self.docs], "<u4")
        where = np.searchsorted(splitters, high, "right")
        cut = np.flatnonzero(np.diff(where, prepend=-1))
        z, ranges, out = zstandard.ZstdCompressor(level=3), where[cut].tolist(), []
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(where)]):
            shared = lcp[s:e].copy()
            shared[0] = 0
            own, local = np.unique(doc[s:e], return_inverse=True)
            tails = b"".join([buf[a:b] + buf[c:d] for a, b, c, d in zip((at[s:e] + shared).tolist(), end[s:e].tolist(), first[s:e].tolist(), at[s:e].tolist())])
            head = np.array([e - s, len(own)], "<u4").tobytes() + ids[own].tobytes() + ths[own].tobytes()
            body = shared.astype("u1").tobytes() + (end[s:e] - at[s:e]).astype("u1").tobytes() + (at[s:e] - first[s:e]).astype("u1").tobytes()
            out.append(z.compress(head + body + planes(local) + planes(first[s:e] - starts[doc[s:e]]) + tails))
        return ranges, out


def decoded(blob: bytes) -> tuple[list[bytes], list[int], list[bytes], list[int], list[int], list[int]]:
    """(suffixes, lengths of shared prefixes, bytes in front, ids, text hashes, first windows) of a run."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    at = 8

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(raw, kind, count, at)
        at += x.nbytes
        return x

    ids, ths = take("<i8", m), take("<u4", m)
    shared, right, left = (take("u1", n).astype(np.int64) for _ in range(3))
    doc, first = (np.ascontiguousarray(take("u1", 4 * n).reshape(4, n).T).view("<u4")[:, 0] for _ in range(2))
    ends = at + np.cumsum(right - shared + left)
    mids = ends - left
    suffixes, before, last = [], [], b""
    for h, a, b, c in zip(shared.tolist(), (mids - right + shared).tolist(), mids.tolist(), ends.tolist()):
        last = last[:h] + raw[a:b]
        suffixes.append(last)
        before.append(raw[b:c])
    return suffixes, shared.tolist(), before, ids[doc].tolist(), ths[doc].tolist(), first.tolist()


def merged(runs: list[list[bytes]], shared: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, length of the prefix shared with the one before) of all strings in order."""
    k = 1
    while k < len(runs):
        k *= 2
    head: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    known, place = [0] * k, [0] * k
    tree = [0] * k

    def winner(node: int) -> int:
        if node >= k:
            return node - k
        a, b = winner(2 * node), winner(2 * node + 1)
        x, y = head[a], head[b]
        if x is None or y is not None and y < x:
            a, b = b, a
        tree[node] = b
        if head[b] is not None:
            known[b] = common(head[a], head[b])
        return a

    w = winner(1) if k > 1 else 0
    while head[w] is not None:
        yield w, place[w], known[w]
        i = place[w] = place[w] + 1
        run = runs[w]
        if i < len(run):
            head[w], known[w] = run[i], shared[w][i]
        else:
            head[w] = None
        node = (w + k) >> 1
        while node:
            b = tree[node]
            y = head[b]
            if y is not None:
                x = head[w]
                if x is None:
                    tree[node], w = w, b
                else:
                    hw, hb = known[w], known[b]
                    if hb > hw:
                        tree[node], w = w, b
                    elif hb == hw:
                        if x == y:
                            known[b] = len(x)
                        else:
                            h, n = hw, min(len(x), len(y))
                            while h < n and x[h] == y[h]:
                                h += 1
                            if h == n and len(y) < len(x) or h < n and y[h] < x[h]:
                                known[w] = h
                                tree[node], w = w, b
                            else:
                                known[b] = h
            node >>= 1


def spans_of(start: int, hits: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Byte spans from the windows that hit, each window starting one byte after the one before."""
    i, n = 0, len(hits)
    while i < n:
        if hits[i]:
            k = i
            while k + 1 < n and hits[k + 1]:
                k += 1
            yield start + i, start + k + size
            i = k
        i += 1


def leftmost(shared: list[int], size: int) -> list[list[bytes]]:
    """For each of some sorted suffixes, by the lengths of the prefixes that neighbours share: at depths GRAM to size, the first suffix that agrees with it so far, as 4 bytes."""
    n = size - GRAM + 1
    row = [bytes(4)] * n
    out = [row]
    for k, h in enumerate(shared[1:], 1):
        cut = min(max(h - GRAM + 1, 0), n)
        row = row[:cut] + [k.to_bytes(4)] * (n - cut)
        out.append(row)
    return out


def settle(strings: dict[tuple[bytes, bytes], list], shared: list[int], o: Strings) -> Iterator[tuple]:
    """Rows of a group. strings: (bytes in front, suffix) to [smallest id, places, name where places were given out, number of the suffix]; a place is (id, text hash, first window).

    Windows are equal if they have the same bytes in front and their suffixes share a
    prefix up to the window's end, so a window is known by those bytes, whose number
    is the depth left, and by the first suffix that agrees so deep.
    """
    least: dict[bytes, int] = {}
    if len(strings) > 1:
        agree = leftmost(shared, o.size)
        known = {}
        for s, (low, _, _, k) in strings.items():
            a, b = s
            deep = o.size - len(a) - GRAM
            keys = known[s] = [a[i:] + x for i, x in enumerate(agree[k][deep : deep + len(a) + len(b) - o.size + 1])]
            for x in keys:
                m = least.get(x)
                if m is None or low < m:
                    least[x] = low
    for s, (low, places, given, _) in strings.items():
        lows = [least[x] for x in known[s]] if least else [low] * (len(s[0]) + len(s[1]) - o.size + 1)
        for doc, th, first in places:
            for lo, hi in spans_of(first, [m < doc for m in lows], o.size):
                yield doc, th, lo, hi, None, None
        if given:
            yield None, None, None, None, given, lows


def runs_of(docs: DataFrame, splitters: np.ndarray, o: Strings) -> DataFrame:
    """range, blob: front-coded sorted runs of id, th, text. Rows without an id have no place in the order of ids and send nothing."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(r: Run) -> pa.RecordBatch:
            ranges, blobs = r.blobs(splitters)
            return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(blobs, pa.binary())], ["range", "blob"])

        held = Run()
        for b in batches:
            part, size = [], 0
            for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode()
                part.append((doc, th, raw))
                size += len(raw)
                if size > 1 << 20:
                    held.add(part, o.size)
                    part, size = [], 0
                if held.base > o.flush:
                    yield out(held)
                    held = Run()
            held.add(part, o.size)
        if held.parts:
            yield out(held)

    return docs.mapInArrow(freed(run), "range long, blob binary")


def matches(runs: DataFrame, o: Strings) -> DataFrame:
    """id, th, lo, hi: bytes to remove; or those and key, where a string's places are too many to hold; or key and lows, by which those are settled."""
    ordered = runs.repartition(partitions(runs.sparkSession), "range").sortWithinPartitions("range")
    small_batches(runs.sparkSession, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], ["id", "th", "lo", "hi", "key", "lows"])

        def merge(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            runs = [decoded(b) for b in blobs]
            rows: list[tuple] = []
            group: list[tuple[int, int, int]] = []

            def close() -> None:
                if len({runs[r][3][i] for r, i, _ in group}) < 2:
                    return
                if len(group) == 2:  # windows agree only if prefix and front together are as long
                    (r, i, _), (q, j, h) = group
                    if h + common(runs[r][2][i][::-1], runs[q][2][j][::-1]) < o.size:
                        return
                strings: dict[tuple[bytes, bytes], list] = {}
                shared, last = [], None
                for r, i, h in group:
                    x = runs[r]
                    if x[0][i] != last:
                        last = x[0][i]
                        shared.append(h)
                    s = (x[2][i], last)
                    e = strings.get(s)
                    if e is None:
                        e = strings[s] = [x[3][i], [], None, len(shared) - 1]
                    elif x[3][i] < e[0]:
                        e[0] = x[3][i]
                    e[1].append((x[3][i], x[4][i], x[5][i]))
                for s, e in strings.items():
                    if len(e[1]) > o.many:
                        e[2] = hashlib.blake2b(len(s[0]).to_bytes(4) + s[0] + s[1], digest_size=16).digest()
                        rows.extend((d, th, f, f + len(s[0]) + len(s[1]), e[2], None) for d, th, f in e[1])
                        e[1] = []
                rows.extend(settle(strings, shared, o))

            for r, i, h in merged([x[0] for x in runs], [x[1] for x in runs]):
                if h < GRAM:
                    if len(group) > 1:
                        close()
                        if len(rows) > 20_000:
                            yield batch(rows)
                            rows.clear()
                    group = [(r, i, h)]
                else:
                    group.append((r, i, h))
            if len(group) > 1:
                close()
            yield batch(rows)

        now, blobs = None, []
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now and blobs:
                    yield from merge(blobs)
                    blobs = []
                now = k
                blobs.append(blob)
        if blobs:
            yield from merge(blobs)

    return ordered.mapInArrow(freed(run), "id long, th long, lo long, hi long, key binary, lows array<long>")


def choose_splitters(docs: DataFrame, o: Strings) -> np.ndarray:
    """First 8 bytes of suffixes that part those of o.sample documents, chosen by a hash, evenly. Of those documents, 1024 heads each reach the driver at most."""
    n = o.ranges * partitions(docs.sparkSession)
    chosen = docs.select("id", "th").orderBy(F.xxhash64("id", "th")).limit(o.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros(0, np.int64)]
            for t in b.column(0).to_pylist():
                raw = np.frombuffer(t.encode(), np.uint8)
                at = anchors(raw, np.array([len(raw)]), o.size)[2]
                at = at[:: 1 + len(at) // 1024]
                found.append(np.ascontiguousarray(heads(raw, at)[:, :8]).view(">u8")[:, 0].astype(U).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["head"])

    some = docs.join(F.broadcast(chosen), ["id", "th"], "left_semi").select("text").mapInArrow(freed(run), "head long").toPandas()["head"].to_numpy()
    if not len(some):
        return np.zeros(0, U)
    first = np.sort(some.view(U))
    return np.unique(first[np.linspace(0, len(first) - 1, n + 1)[1:-1].astype(int)])


def remove_later_copies(docs: DataFrame, o: Strings = Strings(), with_text: bool = True, few: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (binary, else null): one row for each row of docs.

    A byte goes if it lies in o.size bytes that also start in a document of smaller
    doc_id. A null or empty text has no bytes; texts under o.size bytes stay, as do
    rows without a doc_id, which no other row is held against. Rows of one doc_id
    aren't held against each other. A text that a smaller doc_id has too goes
    whole, found by its digest, and isn't sorted; which ones, is broadcast if they
    are `few`, and joined by a shuffle beyond that.
    """
    k = keyed(docs)
    slim = k.where("doc_id is not null").select("id", "th", "text")
    digests = written(slim.where(F.octet_length("text") >= o.size).select("id", "th", F.unhex(F.sha2("text", 256)).alias("digest")), "suffix-texts")
    lowest = digests.groupBy("digest").agg(F.min("id").alias("lowest"), F.max("id").alias("highest")).where("lowest < highest")
    copies = written(digests.join(lowest, "digest").where("id > lowest").select("id", "th").distinct(), "suffix-copies")
    discard(digests)
    known = F.broadcast(copies) if copies.count() <= few else copies
    slim = slim.join(known, ["id", "th"], "left_anti")
    found = written(matches(runs_of(slim, choose_splitters(slim, o), o), o), "suffix-matches")
    release(docs.sparkSession)
    plain = found.where("key is null").select("id", "th", "lo", "hi")
    lows = found.where("lows is not null").select("key", "lows")
    many = found.where("key is not null and id is not null").select("key", "id", "th", F.col("lo").alias("first")).join(lows, "key")
    windows = many.select("id", "th", "first", F.posexplode("lows").alias("i", "low")).where("low < id")
    settled = windows.select("id", "th", (F.col("first") + F.col("i")).alias("lo"), (F.col("first") + F.col("i") + o.size).alias("hi"))
    hits = plain.unionByName(settled).groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("hits"))
    marked = k.join(known.withColumn("copy", F.lit(True)), ["id", "th"], "left").withColumn("n", F.octet_length("text").cast("long"))
    marked = marked.withColumn("copy", F.coalesce("copy", F.lit(False)) & F.col("doc_id").isNotNull())
    whole = marked.where("copy").select("doc_id", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit(b"" if with_text else None).cast("binary").alias("kept"))
    both = squeezed(marked.where("not copy").select("id", "th", "text", "doc_id")).join(hits, ["id", "th"], "left").select("doc_id", "z", "hits")
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        un = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc, z, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw, spans = un.decompress(z), []
                if doc is not None:
                    for lo, hi in sorted((h["lo"], h["hi"]) for h in hits.as_py() or ()):
                        if spans and lo <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], hi)
                        else:
                            spans.append([lo, hi])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join([raw[a:z] for a, z in zip(edges[::2], edges[1::2])])
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(freed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").unionByName(whole)


def op3_suffix_dedup(spark, sf_dir):
    return remove_later_copies(documents(spark, sf_dir), with_text=False).drop("kept")
