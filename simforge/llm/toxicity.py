"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of itself and of its character n-grams, each hashed to a row
of an embedding matrix, so a misspelling that training never saw shares most of
its rows with the word it stands for. A document is the mean of all rows of all
its words. Embeddings and the softmax above them are learned together by Adam.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, freed, small_batches, texts

U = np.uint64


@dataclass(frozen=True)
class Options:
    """sample: the most labelled rows to learn from, a bound on what the driver holds; which ones, a hash of doc_id says."""

    buckets_log2: int = 17
    dim: int = 8
    shortest: int = 3
    longest: int = 6
    sample: int = 8_000
    epochs: int = 8
    least_steps: int = 300
    batch: int = 128
    rate: float = 0.1
    decay: float = 1e-5
    positive_weight: float = 3.0
    seed: int = 7


def features(words: list[str], o: Options) -> tuple[np.ndarray, np.ndarray]:
    """(rows, first): the embedding rows of all words one after the other, and where each word's begin; every word has one or more."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(U) + U(1)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(ends, sizes) - np.arange(len(points))
    shift = U(64 - o.buckets_log2)

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15)
        return ((h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)) >> shift

    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=1)), 0x100000001B3, U))
        whole = mixed(np.add.reduceat(points * powers[np.arange(len(points)) - np.repeat(starts, sizes)], starts)) if len(words) else np.zeros(0, U)
        rows, owner = [whole], [np.arange(len(words))]
        h = points.copy()
        for n in range(2, o.longest + 1):
            h = h[:-1] * U(0x100000001B3) + points[n - 1 :] if len(h) else h
            if n >= o.shortest:
                ok = room[: len(h)] >= n
                rows.append(mixed(h[ok] + U(n)))
                owner.append(word[: len(h)][ok])
    owner, rows = np.concatenate(owner), np.concatenate(rows).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.searchsorted(owner[order], np.arange(len(words)))


def split(text: str) -> list[str]:
    return text.lower().split()


class Bags:
    """Documents as sparse counts of embedding rows."""

    def __init__(self, docs: list[str], o: Options):
        self.ids, self.shares = [], []
        for text in docs:
            n = Counter(split(text))
            rows, first = features(list(n), o)
            times = np.repeat(np.fromiter(n.values(), np.float32, len(n)), np.diff(np.append(first, len(rows))))
            r, inverse = np.unique(rows, return_inverse=True)
            weight = np.bincount(inverse, times, minlength=len(r))
            self.ids.append(r.astype(np.int32))
            self.shares.append((weight / max(1.0, weight.sum())).astype(np.float32))


def train(docs: list[str], toxic: list[int], o: Options = Options()) -> tuple[np.ndarray, float]:
    """(what each embedding row adds to the logit of label 1, bias). Without rows of both labels: zeros and the log odds of the prior."""
    y = np.array(toxic, np.float32)
    table = np.zeros(1 << o.buckets_log2, np.float32)
    if len(set(toxic)) < 2:
        return table, 0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1)
    bags, rng = Bags(docs, o), np.random.default_rng(o.seed)
    params = [rng.normal(0, 0.1, (1 << o.buckets_log2, o.dim)).astype(np.float32), rng.normal(0, 1, (o.dim, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight, step = np.where(y > 0, o.positive_weight, 1.0).astype(np.float32), 0
    batches = -(-len(y) // o.batch)
    epochs = max(o.epochs, -(-o.least_steps // batches))
    steps = epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), o.batch):
            some = order[at : at + o.batch]
            ids, shares = np.concatenate([bags.ids[i] for i in some]), np.concatenate([bags.shares[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(bags.ids[i]) for i in some])
            emb, soft, bias = params
            got = emb[ids] * shares[:, None]
            mean = np.stack([np.bincount(owner, got[:, k], len(some)) for k in range(o.dim)], 1).astype(np.float32)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some].astype(int)] -= 1
            p *= (weight[some] / len(some))[:, None]
            down = (p @ soft.T)[owner] * shares[:, None]
            used, inverse = np.unique(ids, return_inverse=True)
            grown = np.stack([np.bincount(inverse, down[:, k], len(used)) for k in range(o.dim)], 1).astype(np.float32)
            step += 1
            rate = o.rate * (1 - (step - 1) / steps)
            for q, (grad, rows) in enumerate(((grown, used), (mean.T @ p, slice(None)), (p.sum(0), slice(None)))):
                grad = grad + o.decay * params[q][rows]
                m = first[q][rows] = 0.9 * first[q][rows] + 0.1 * grad
                v = second[q][rows] = 0.999 * second[q][rows] + 0.001 * grad * grad
                params[q][rows] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    emb, soft, bias = params
    return (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores by the linear form of a model: a word's share of the logit doesn't depend on the rest of its text."""

    def __init__(self, table: np.ndarray, bias: float, o: Options, cached: int = 300_000):
        self.table, self.bias, self.o, self.cached, self.cache = table, bias, o, cached, {}

    def scores(self, batch: list[str]) -> list[float]:
        words = [split(t) for t in batch]
        if len(self.cache) > self.cached:
            self.cache.clear()
        new = list(set().union(*words) - self.cache.keys())
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            rows, first = features(some, self.o)
            n = np.diff(np.append(first, len(rows)))
            sums = np.add.reduceat(self.table[rows].astype(np.float64), first)
            self.cache.update(zip(some, zip(sums.tolist(), n.tolist())))
        get, out = self.cache.__getitem__, []
        for ws in words:
            if ws:
                s, n = zip(*map(get, ws))
                z = sum(s) / sum(n) + self.bias
            else:
                z = self.bias
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> tuple[np.ndarray, float]:
    """Trains on labelled documents whose crc32(doc_id as text) mod 5 is not 0, o.sample of them at most. Null labels and ids are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(o.sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text, r.toxic))
    return train([r.text for r in rows], [r.toxic for r in rows], o)


def score(docs: DataFrame, table: np.ndarray, bias: float, o: Options = Options()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, where it lies. A null or empty text scores the model's bias.

    The model is one number for each embedding row, 0.5 MB, whatever the corpus.
    A null doc_id is not held out. Repeated rows get equal scores.
    """
    small_batches(docs.sparkSession)
    raw = table.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(np.frombuffer(raw, np.float32), bias, o)
        for b in batches:
            s = scorer.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i is not None and held_out(i) for i in b.column(0).to_pylist()], pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return texts(docs).mapInArrow(freed(run), "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark, sf_dir):
    docs, o = documents(spark, sf_dir), Options()
    table, bias = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), o)
    return score(docs, table, bias, o)
