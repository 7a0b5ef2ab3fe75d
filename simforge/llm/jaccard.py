"""N-gram Jaccard join by a count-vector R-tree.

The tokens of a document, its distinct word n-grams, are hashed into groups.
Every pair above the threshold is found in two steps:

Partition. All tokens are put into one order, rare ones first, by a sketch of
counts over all documents. Two documents above the threshold share a token among
the first few of both, so the pair meets in the bucket of that token. A passage
that many documents hold comes last in the order, and makes no bucket of
documents that have nothing else in common. Buckets with the same members are
one bucket.

Search. In a bucket, the counts of tokens by group are points of an R-tree. The
sum of the smaller coordinates of two points bounds their overlap from above,
and the sum of the smaller of a point's coordinates and a node's greatest ones
bounds it for all points below the node. Pairs that survive are verified on the
token sets themselves.

A bucket isn't searched for all of its pairs at once: each member is first held
against the bucket's smallest one, and links so found make components. In small
buckets, pairs across components follow. In large ones, members outside the
bucket's largest component query it, in blocks with a tree each, where a link
found joins components on the spot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, freed, partitions, small_batches, whole_groups, written
from .components import components

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(97)
#: A random number for each byte, by a fixed seed; upper-case ASCII shares that of lower case.
BYTE = _rng.integers(1, 2**64, 256, dtype=U)
BYTE[65:91] = BYTE[97:123]
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Rows that a sketch is sent in. Digests that a task remembers.
CHUNKS, SEEN = 64, 200_000


@dataclass(frozen=True)
class Join:
    """n: words to a shingle. percent: the least Jaccard similarity of a link. dims: coordinates of a point. small: the most members of a bucket searched whole; block: of one tree. cells: of the sketch that orders tokens."""

    n: int = 4
    percent: int = 85
    dims: int = 48
    small: int = 64
    block: int = 2048
    leaf: int = 8
    cells: int = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        return h ^ (h >> U(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of every word, number of words of each text)."""
    raws = [t.encode() for t in texts]
    raw = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    blank = BLANK[raw]
    inside = ~blank
    starts = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]]))
    stops = np.flatnonzero(blank & np.concatenate([[False], inside[:-1]]))
    sizes = stops - starts
    ends = np.cumsum([len(r) + 1 for r in raws]) if raws else np.zeros(0, np.int64)
    words = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, U), words
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), BASE, U))
        letters = BYTE[raw[inside]]
        at = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return mix(np.add.reduceat(letters * powers[at], np.cumsum(sizes) - sizes) + sizes.astype(U)), words


def token_sets(texts: list[str], n: int = 4) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, words = word_hashes(texts)
    with np.errstate(over="ignore"):
        if len(h) >= n:
            s = h[: len(h) - n + 1].copy()
            for k in range(1, n):
                s = s * BASE + h[k : len(h) - n + 1 + k]
            s = mix(s)
        out, at = [], 0
        for w in words.tolist():
            if w >= n:
                out.append(np.unique(s[at : at + w - n + 1]))
            elif w:
                one = U(w)
                for x in h[at : at + w]:
                    one = one * BASE + x
                out.append(mix(np.array([one])))
            else:
                out.append(np.zeros(0, U))
            at += w
    return out


def cells(tokens: np.ndarray, n: int) -> np.ndarray:
    """The cell of the sketch that counts each token."""
    return (mix(tokens + BASE) % U(n)).astype(np.int64)


def prefix(tokens: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The tokens that come first, rare ones before frequent ones, as many as two linked documents can't both have without one in common.

    A document of n tokens shares at least o = percent / 100 * n of them with any
    that it links with, as their union has n or more. The first common token of two
    linked documents is therefore among the first n - o + 1 of both. That holds for
    any order that is the same for all; ranks, of the tokens' cells, only decide
    which tokens it puts first.
    """
    n = len(tokens)
    m = n - -(-percent * n // 100) + 1
    if m >= n:
        return tokens
    # Stable, and tokens come sorted: equal ranks go by the token.
    order = np.argsort((ranks[cells(tokens, len(ranks))].astype(U) << U(56)) | (mix(tokens) >> U(8)), kind="stable")
    return tokens[order[:m]]


def point(tokens: np.ndarray, dims: int) -> np.ndarray:
    return np.bincount((mix(tokens ^ BASE) % U(dims)).astype(np.int64), minlength=dims).astype("<u4")


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


class RTree:
    """Points packed into leaves by size, then levels of boxes above them. Only the greatest coordinates of a box, and the sizes in it, matter to a search."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 16):
        self.order = np.lexsort([points.argmax(1), sizes])
        self.points, self.sizes, self.fan = points[self.order], sizes[self.order], leaf
        self.levels = []
        high, lo, hi = self.points, self.sizes, self.sizes
        while len(high) > leaf:
            cut = np.arange(0, len(high), leaf)
            high, lo, hi = np.maximum.reduceat(high, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            self.levels.append((high, lo, hi))

    def search(self, p: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Places of points whose bound allows the similarity with p, a point of n tokens."""
        at = None
        for high, lo, hi in reversed(self.levels):
            at = np.arange(len(high)) if at is None else self._below(at, len(high))
            at = at[(100 * n >= percent * lo[at]) & (100 * hi[at] >= percent * n)]
            # of the sizes below, the smallest needs the least overlap
            need = np.maximum(lo[at], -(-percent * n // 100))
            at = at[(100 + percent) * np.minimum(high[at], p).sum(1) >= percent * (n + need)]
        at = np.arange(len(self.points)) if at is None else self._below(at, len(self.points))
        sizes = self.sizes[at]
        at = at[(100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))]
        at = at[(100 + percent) * np.minimum(self.points[at], p).sum(1) >= percent * (n + self.sizes[at])]
        return self.order[at]

    def _below(self, at: np.ndarray, n: int) -> np.ndarray:
        below = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
        return below[below < n]


def profile(docs: DataFrame, j: Join) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, digest (of the set), point: one row for each row of docs; chunk, counts: each task's sketch, how often tokens of each cell occur): one written table, to be discarded as the first's."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_shingles", "digest", "point", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(j.cells, "<u4")
        for b in batches:
            sets = token_sets(b.column(1).to_pylist(), j.n)
            some = np.concatenate([*sets, np.zeros(0, U)])
            for at in range(0, len(some), 1 << 20):
                sketch += np.bincount(cells(some[at : at + (1 << 20)], j.cells), minlength=j.cells).astype("<u4")
            none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([point(s, j.dims).tobytes() for s in sets], pa.binary()), *none], names)
        if sketch.any():
            parts = [x.tobytes() for x in np.split(sketch, CHUNKS)]
            none = [pa.nulls(CHUNKS, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names)

    out = written(docs.mapInArrow(freed(run), "doc_id long, n_shingles long, digest binary, point binary, chunk int, counts binary"), "jaccard-profile")
    rows = out.where("chunk is null").select(*names[:4])
    rows.written_at = out.written_at
    return rows, out.where("chunk is not null").select("chunk", "counts")


def token_ranks(sketches: DataFrame, j: Join) -> np.ndarray:
    """A byte for each cell, the higher the more tokens fell there. The sum of all tasks' sketches has j.cells numbers, however many documents there are."""
    small_batches(sketches.sparkSession, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, "<u4").astype("<u8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    counts = np.zeros((CHUNKS, j.cells // CHUNKS))
    for r in sketches.repartition(min(partitions(sketches.sparkSession), CHUNKS), "chunk").mapInArrow(freed(run), "chunk int, counts binary").collect():
        counts[r["chunk"]] = np.frombuffer(r["counts"], "<u8")
    return np.minimum(4 * np.log2(1 + counts.ravel()), 255).astype(np.uint8)


def buckets(docs: DataFrame, ranks: np.ndarray, j: Join) -> DataFrame:
    """key, node: a row for each bucket of each document; a set that its task has met before isn't sent again."""
    small_batches(docs.sparkSession)
    raw = ranks.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        ranks = np.frombuffer(raw, np.uint8)
        for b in batches:
            keys, nodes = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for doc, s in zip(b.column(0).to_pylist(), token_sets(b.column(1).to_pylist(), j.n)):
                if not len(s) or doc is None or (d := set_digest(s)) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(d)
                k = prefix(s, ranks, j.percent)
                keys.append(k)
                nodes.append(np.full(len(k), doc))
            keys, nodes = np.concatenate(keys).view(np.int64), np.concatenate(nodes)
            for at in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 200_000]), pa.array(nodes[at : at + 200_000])], ["key", "node"])

    return docs.mapInArrow(freed(run), "key long, node long")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """bucket, node of the buckets with two members or more; buckets of the same members have one name, and a task sends it once.

    Rows come sorted by bucket, so a task holds one bucket's members, 8 bytes each.
    """
    spark = rows.sparkSession
    ordered = rows.repartition(partitions(spark), "key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def groups(keys: np.ndarray, nodes: np.ndarray) -> list[pa.RecordBatch]:
            if not len(keys):
                return []
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(first, len(keys)))
            names, members = [], []
            for at, n in zip(first[size > 1].tolist(), size[size > 1].tolist()):
                own = np.unique(nodes[at : at + n])
                if len(own) < 2:
                    continue
                name = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                if name in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(name)
                names.append(np.full(len(own), name))
                members.append(own)
            return [pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(members))], ["bucket", "node"])] if names else []

        held_k, held_n = [], []
        for b in batches:
            k, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            if held_k and held_k[-1][-1] == k[-1]:  # the batch is all of one bucket
                held_k.append(k)
                held_n.append(n)
                continue
            keys, nodes = np.concatenate([*held_k, k]), np.concatenate([*held_n, n])
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            yield from groups(keys[:cut], nodes[:cut])
            held_k, held_n = [keys[cut:]], [nodes[cut:]]
        if held_k:
            yield from groups(np.concatenate(held_k), np.concatenate(held_n))

    return ordered.mapInArrow(freed(run), "bucket long, node long")


def points_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1).astype(np.int64)


def search_small(members: DataFrame, j: Join, hubs: bool) -> DataFrame:
    """a, b: surviving pairs within buckets (bucket, node, n_shingles, point, component) of j.small members at most.

    With hubs, pairs of a bucket's smallest member with the others; without, those
    of the others with each other that are in different components. Buckets under a
    leaf need no tree: those of one size are bounded together.
    """
    spark = members.sparkSession
    small_batches(spark, 2000)
    ordered = members.select("bucket", "node", "n_shingles", "point", "component").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            keys, nodes, sizes, points, comp = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy(), points_of(t.column(3)), t.column(4).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            count = np.diff(np.append(first, len(keys)))
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n in np.unique(count).tolist():
                groups = first[count == n]
                if n > j.leaf:
                    for at in groups.tolist():
                        tree = RTree(points[at : at + n], sizes[at : at + n], j.leaf)
                        for i in range(1 if hubs else n):
                            if not hubs and i == 0:
                                continue
                            hits = tree.search(points[at + i], sizes[at + i], j.percent)
                            hits = at + hits[hits > i]
                            hits = hits if hubs else hits[comp[hits] != comp[at + i]]
                            left.append(np.full(len(hits), at + i))
                            right.append(hits)
                    continue
                x, y = np.triu_indices(n, 1)
                x, y = (x[x == 0], y[x == 0]) if hubs else (x[x > 0], y[x > 0])
                if not len(x):
                    continue
                for some in np.array_split(groups, max(1, len(groups) * len(x) // 50_000)):
                    a, b = (some[:, None] + x).ravel(), (some[:, None] + y).ravel()
                    if not hubs:
                        apart = comp[a] != comp[b]
                        a, b = a[apart], b[apart]
                    ok = (100 + j.percent) * np.minimum(points[a], points[b]).sum(1) >= j.percent * (sizes[a] + sizes[b])
                    ok &= 100 * np.minimum(sizes[a], sizes[b]) >= j.percent * np.maximum(sizes[a], sizes[b])
                    left.append(a[ok])
                    right.append(b[ok])
            a, b = nodes[np.concatenate(left)], nodes[np.concatenate(right)]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return ordered.mapInArrow(freed(run), "a long, b long").distinct()


def bounded(pairs: DataFrame, points: DataFrame, j: Join) -> DataFrame:
    """The pairs (a, b) that the bound lets through. points: node, n_shingles, point."""
    p = lambda k: points.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("point").alias(f"p{k}"))
    both = pairs.join(p("a"), "a").join(p("b"), "b").select("a", "b", "na", "nb", "pa", "pb")
    small_batches(pairs.sparkSession, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m, n = b.column(2).to_numpy(), b.column(3).to_numpy()
            ok = (100 + j.percent) * np.minimum(points_of(b.column(4)), points_of(b.column(5))).sum(1) >= j.percent * (m + n)
            keep = pa.array(ok & (100 * np.minimum(m, n) >= j.percent * np.maximum(m, n)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(freed(run), "a long, b long")


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * same >= percent * (len(s) + len(t) - same) > 0


def search_blocks(strays: DataFrame, members: DataFrame, j: Join) -> DataFrame:
    """a, b: links of strays with members of other components of their bucket, block by block (bucket, block, node, n_shingles, point, component, z).

    Survivors of the bound are verified on the spot, and a link joins two
    components, whose members needn't be held against each other any more. So a
    block gives fewer links than it has components.
    """

    def run(key, left, right):
        import zlib

        import pandas as pd

        out = []
        if len(left) and len(right):
            nodes, comp = right["node"].to_numpy(), right["component"].to_numpy()
            tree, sets, parent = RTree(np.stack([np.frombuffer(p, "<u4") for p in right["point"]]).astype(np.int64), right["n_shingles"].to_numpy(), j.leaf), {}, {}

            def root(c):
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            for node, n, p, c, z in zip(left["node"], left["n_shingles"], left["point"], left["component"], left["z"]):
                own = None
                for h in tree.search(np.frombuffer(p, "<u4").astype(np.int64), n, j.percent):
                    if root(comp[h]) == root(c):
                        continue
                    if own is None:
                        own = token_sets([zlib.decompress(z).decode()], j.n)[0]
                    if h not in sets:
                        sets[h] = token_sets([zlib.decompress(right["z"].iat[h]).decode()], j.n)[0]
                    if linked(own, sets[h], j.percent):
                        parent[root(comp[h])] = root(c)
                        out.append((min(node, nodes[h]), max(node, nodes[h])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return strays.groupBy("bucket", "block").cogroup(members.groupBy("bucket", "block")).applyInPandas(run, "a long, b long").distinct()


def small_texts(docs: DataFrame, ids: DataFrame, few: int = 1_000_000) -> DataFrame:
    """node, z: written, the compressed texts of the documents whose ids (node, written) are wanted. They are broadcast if they are few."""
    import zlib

    ids = ids.withColumnRenamed("node", "doc_id")
    wanted = docs.join(F.broadcast(ids) if ids.count() <= few else ids, "doc_id", "left_semi")
    small_batches(docs.sparkSession)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(t.encode(), 1) for t in b.column(1).to_pylist()], pa.binary())], ["node", "z"])

    return written(wanted.mapInArrow(freed(squeeze), "node long, z binary"), "jaccard-texts", "none")


def verify(pairs: DataFrame, z: DataFrame, j: Join) -> DataFrame:
    """The pairs (a, b) that link, written. z: node, z, the compressed texts."""
    import zlib

    both = pairs.join(z.withColumnRenamed("node", "a").withColumnRenamed("z", "za"), "a").join(z.withColumnRenamed("node", "b").withColumnRenamed("z", "zb"), "b").select("a", "b", "za", "zb")
    small_batches(pairs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            texts = list(dict.fromkeys([*left, *right]))
            sets = dict(zip(texts, token_sets([zlib.decompress(t).decode() for t in texts], j.n)))
            keep = pa.array([linked(sets[x], sets[y], j.percent) for x, y in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return written(both.mapInArrow(freed(run), "a long, b long"), "jaccard-links")


def jaccard_components(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs.

    A null text, or one without words, has no tokens and links with nothing. A row
    without a doc_id has no component (null) and links with nothing. Rows with one
    doc_id are one document: it links if one of its texts does. Documents with equal
    sets link; one of them, the smallest id, stands for all in the search.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, sketches = profile(docs, j)
    some = rows.where("n_shingles > 0 and doc_id is not null")
    low = some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("point").alias("point"))
    reps = written(low, "jaccard-sets")
    ids = some.join(reps.select("digest", "rep"), "digest").select(F.col("doc_id").alias("node"), "rep").distinct()

    found = written(shared_buckets(buckets(docs, token_ranks(sketches, j), j)), "jaccard-buckets")
    # Which of several equal documents a task sent doesn't matter: their representative takes their place.
    members = found.join(ids, "node").select("bucket", F.col("rep").alias("node")).distinct()
    members = written(members, "jaccard-members")
    discard(found)
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    points = reps.select(F.col("rep").alias("node"), "n_shingles", "point")
    sized = members.join(sizes, "bucket")
    few = sized.where(F.col("n") <= j.small).select("bucket", "node")
    first = search_small(few.join(points, "node").withColumn("component", F.col("node")), j, hubs=True)
    star = sized.where((F.col("n") > j.small) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    pairs = written(first.unionByName(bounded(star, points, j)).distinct(), "jaccard-pairs")
    z = small_texts(docs, written(ends(pairs), "jaccard-needed"))
    same = ids.where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    links = verify(pairs, z, j).unionByName(same)
    comps = components(links)

    # The others of a small bucket, where they are not in one component yet.
    of = lambda rows: rows.join(comps, "node", "left").withColumn("component", F.coalesce("component_id", "node")).drop("component_id")
    mixed_rows = written(of(few), "jaccard-small")
    mixed = mixed_rows.join(mixed_rows.groupBy("bucket").agg(F.count_distinct("component").alias("k")).where("k > 1").select("bucket"), "bucket")
    rest = written(search_small(mixed.join(points, "node"), j, hubs=False), "jaccard-pairs")
    late = written(ends(rest).join(z.select("node"), "node", "left_anti"), "jaccard-needed")
    more = verify(rest, z.unionByName(small_texts(docs, late)), j)

    # Members of large buckets outside the bucket's largest component query it.
    large = written(of(sized.where(F.col("n") > j.small).select("bucket", "node", "n")), "jaccard-large")
    most = large.groupBy("bucket", "component").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("base"))
    strays = large.join(most, "bucket").where("component != base")
    if strays.limit(1).count():
        number = F.ceil(F.col("n") / j.block).cast("int")
        asked = written(large.join(strays.select("bucket").distinct(), "bucket", "left_semi").select("node").distinct().join(z.select("node"), "node", "left_anti"), "jaccard-needed")
        known = points.join(z.unionByName(small_texts(docs, asked)), "node")
        columns = ("bucket", "block", "node", "n_shingles", "point", "component", "z")
        blocks = large.join(strays.select("bucket").distinct(), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), number).cast("int")).join(known, "node").select(*columns)
        queries = strays.withColumn("block", F.explode(F.sequence(F.lit(0), number - 1))).join(known, "node").select(*columns)
        more = more.unionByName(written(search_blocks(written(queries, "jaccard-queries"), written(blocks, "jaccard-blocks"), j), "jaccard-links"))
    if more.limit(1).count():
        comps = components(links.unionByName(more))
    discard(members, pairs, z, rest, mixed_rows, large)
    out = rows.join(comps, rows["doc_id"] == comps["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir))


def one_of_each(docs: DataFrame, j: Join = Join(n=5, percent=80)) -> DataFrame:
    """The document with the smallest id of each component of near duplicates, with its own columns. Rows without an id stay."""
    lowest = jaccard_components(docs, j).where("doc_id = component_id").select(F.col("doc_id").alias("lowest")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(lowest, F.col("id") == F.col("lowest"), "left").where("lowest is not null or id is null").select("row.*")
