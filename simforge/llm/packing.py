"""Packing documents into sequences by shortest-pack-first over the length histogram.

Documents become pieces of at most a sequence's length. Only the histogram of
piece lengths, one row for each length, reaches the driver. There lengths are
placed longest first, each into the pattern with the most room, by updating the
counts of patterns. Pieces then take their places by rank within their length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, freed, partitions, small_batches, texts, written

Pattern = tuple[tuple[int, int], ...]


class WordIds:
    """Ids of texts by a tokenizers file that lowers case, and whose pre-tokenizer parts white space, letters and marks.

    Each stretch between white space is encoded once and kept in a bounded cache.
    Texts of Latin-1 alone, where lowering is the same everywhere, are lowered
    first, which lets more stretches share what is kept. Lower-case Latin-1 letters
    are one unit that neither the normaliser nor the pre-tokenizer changes, so many
    of them are encoded as one text without either, and parted at the ids that end
    a word. Marks behind them, of which there are few different runs, are a unit of
    their own, and the ids of both are put together. A file for which that doesn't hold, by trial, encodes texts whole.
    """

    #: Python splits at these, Unicode doesn't call them white space: texts with them are encoded whole.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    #: Letters and ASCII marks. An apostrophe may belong to what follows it.
    LETTERS = re.compile(r"(?<![^ ])([a-zªµºß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)(?![^ ])")
    TRIAL = "The quick-brown  Fox, jumps. ÀÉÎ õü ß über\tall\n\nlazy dogs' 3.14 e-mail snake_case it's don't: naïve; señor? (ªº) x1y2 漢字 αβ."

    def __init__(self, path: str, cached: int = 600_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.plain, self.cached = Tokenizer.from_file(path), Tokenizer.from_file(path), cached
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.by_words = True
        samples = [self.TRIAL, self.TRIAL.lower(), "abc,", "a, b. c", ""]
        self.by_words = self.last.any() and self.ids(samples) == [self._whole(t) for t in samples]
        self.cache.clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _parts(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return text.lower().split()

    def _letters(self, words: list[str]) -> None:
        """Keeps the ids of words of lower-case Latin-1 letters."""
        cache, step = self.cache, 256
        texts = [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
        for k, e in enumerate(self.plain.encode_batch_fast(texts, add_special_tokens=False)):
            ids, some = np.array(e.ids, "<u4"), words[k * step : (k + 1) * step]
            raw, cuts = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(cuts) == len(some):
                at = 0
                for w, end in zip(some, cuts):
                    cache[w] = raw[at:end]
                    at = end
            else:
                cache.update((w, self._whole(w)) for w in some)

    def ids(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.by_words:
            return [self._whole(t) for t in batch]
        cache = self.cache
        if len(cache) > self.cached:
            cache.clear()
        odd = {t: self._whole(t) for t in batch if any(c in t for c in self.ODD)}
        parts = [() if t in odd else self._parts(t) for t in batch]
        new = set().union(*parts).difference(cache)
        found = self.LETTERS.findall(" ".join(new))
        self._letters(list({w for w, _ in found}.difference(cache)))
        ended = {w + marks: (w, marks) for w, marks in found if marks}
        other = list(new.difference(ended, [w for w, _ in found]).union(marks for _, marks in ended.values()).difference(cache))
        for w, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False)):
            cache[w] = np.array(e.ids, "<u4").tobytes()
        for whole, (w, marks) in ended.items():
            cache[whole] = cache[w] + cache[marks]
        get = cache.__getitem__
        return [odd[t] if t in odd else b"".join(map(get, p)) for t, p in zip(batch, parts)]


_words: dict[str, WordIds] = {}


def pieces_of(docs: DataFrame, path: str, length: int = 2048, end: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and then `end`, cut every `length` ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _words:
            _words[path] = WordIds(path)
        last = end.to_bytes(4, "little")
        for b in batches:
            rows: list[tuple] = []
            for doc, raw in zip(b.column(0).to_pylist(), _words[path].ids(b.column(1).to_pylist())):
                raw += last
                n = len(raw) // 4
                rows += [(doc, s, min(length, n - s), zlib.crc32(raw[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(docs).mapInArrow(freed(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[Pattern, int]]:
    """(pattern, how many sequences have it). A pattern lists (piece length, how often), longest first.

    Its work and result depend on the number of lengths, not of pieces: counts of a pattern are split or moved as one.
    """
    room: dict[int, list[tuple[Pattern, int]]] = {}
    heap: list[int] = []

    def put(free: int, pattern: Pattern, n: int) -> None:
        if n:
            if not room.setdefault(free, []):
                heapq.heappush(heap, -free)
            room[free].append((pattern, n))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            while heap and not room[-heap[0]]:
                heapq.heappop(heap)
            free = -heap[0] if heap else 0
            if free < size:  # none has room: new patterns, filled with this length
                each = length // size
                put(length - size * each, ((size, each),), left // each)
                if left % each:
                    put(length - size * (left % each), ((size, left % each),), 1)
                break
            pattern, n = room[free].pop()
            # Where this length goes in more than once, it goes in as often as there is room and need.
            each = max(1, min(free // size, left // n)) if left >= n else 1
            used = min(n, left // each)
            put(free, pattern, n - used)
            put(free - size * each, (*pattern, (size, each)), used)
            left -= used * each
    merged: dict[Pattern, int] = {}
    for patterns in room.values():
        for p, n in patterns:
            merged[p] = merged.get(p, 0) + n
    return sorted(merged.items(), reverse=True)


def places(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, pieces of that length in each, first offset) of every run of slots."""
    out, taken, sequence = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for size, each in pattern:
            rank = taken.get(size, 0)
            out.append((size, rank, rank + n * each, sequence, each, offset))
            taken[size] = rank + n * each
            offset += size * each
        sequence += n
    return out


def pack(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """pieces (doc_id, start, length, ...) with sequence_id and offset.

    Ranks within a length are numbered apart in as many groups as there are shuffle
    partitions and moved by the counts of the groups before, so that a length that a
    third of all pieces have is no one task's work. Sequences are numbered without
    gaps, and pieces in one stand without gaps from offset 0.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(partitions(spark))).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = written(counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = places(shortest_pack_first(histogram, length))
    table = spark.createDataFrame(slots or [(0, 0, 0, 0, 1, 0)], "length long, _lo long, _hi long, _seq long, _each long, _off long")
    if len(slots) <= 100_000:  # 5 MB; the number of lengths bounds it in practice
        table = F.broadcast(table)
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start")) - 1)
    ranked = ranked.join(counts.select("length", "_salt", "_before").hint("merge"), ["length", "_salt"]).withColumn("_rank", F.col("_row") + F.col("_before"))
    placed = ranked.join(table, ["length"]).where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    k = F.col("_rank") - F.col("_lo")
    return placed.withColumn("sequence_id", F.col("_seq") + F.floor(k / F.col("_each"))).withColumn("offset", F.col("_off") + F.col("length") * (k % F.col("_each"))).select(*pieces.columns, "sequence_id", "offset")


def packed(docs: DataFrame, path: str, length: int = 2048, end: int = 1) -> DataFrame:
    """Documents to pieces with their places. A null or empty text is the end id alone. Repeated rows are packed each for itself."""
    return pack(written(pieces_of(docs, path, length, end), "pieces"), length).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def op6_packing(spark, sf_dir):
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
