"""Token ids in files of directly addressable codes.

A file holds some documents' ids, one after the other, in ascending order of
doc_id. Ids are split into chunks of some bits: the first level has the lowest
chunk of every id, the next level the next chunk of those ids that go on, and so
forth. A bitmap for each level but the last says which ids go on, and its rank
directory counts the ones before every 512th bit, so an id is put together from
one chunk of each level that it reaches, and nothing around it is decoded.

A file's layout, all numbers little-endian:

    "DACF", u32 version, u64 documents, u64 ids, u32 levels, then each level's u32 width in bits and u64 entries
    i64 doc_id of each document, u8 whether it is null
    u64 ids before each document, and all ids
    each level: chunks, low nibble first; for all but the last also the bitmap, lowest bit first, and u32 ones before each block of 512 bits
    u32 crc32 of all that

Sections start at multiples of 8 bytes. Spark has no writer of raw files, and a
task's own files are nothing that a cluster shares, so a row of a Parquet table
holds a file, uncompressed, beside its place in the order.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, freed, partitions, small_batches, texts, written

MAGIC, VERSION, BLOCK = b"DACF", 1, 512


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def widths(ids: np.ndarray) -> list[int]:
    """Bits of each level, multiples of four, that take the least room for these ids."""
    top = max(1, (int(ids.max()).bit_length() + 3) // 4) if len(ids) else 1
    # going[k]: how many ids have more than 4 * k bits, thus an entry in a level that begins there.
    going = [len(ids)] + [int((ids >= 1 << 4 * k).sum()) for k in range(1, top)]
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (top + 1)
    for k in range(top - 1, -1, -1):
        # An entry takes its bits and, unless its level is the last, its bit of the bitmap with the directory's share.
        best[k] = min((going[k] * (4 * (j - k) + (1 + 32 / BLOCK if j < top else 0)) + best[j][0], [4 * (j - k), *best[j][1]]) for j in range(k + 1, top + 1))
    return best[0][1]


def packed_chunks(values: np.ndarray, width: int) -> bytes:
    if width == 8:
        return values.astype(np.uint8).tobytes()
    if width == 16:
        return values.astype("<u2").tobytes()
    nibbles = np.zeros(len(values) * (width // 4) + 1 & ~1, np.uint8)
    for i in range(width // 4):
        nibbles[i : len(values) * (width // 4) : width // 4] = values >> 4 * i & 15
    return (nibbles[::2] | nibbles[1::2] << 4).tobytes()


def encoded(ids: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """(width, entries) of each level, and the levels' sections."""
    shape, out, rest = [], [], ids
    split = widths(ids)
    for width in split[:-1]:
        more = rest >> width
        going = more > 0
        bits = np.packbits(going, bitorder="little")
        ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        shape.append((width, len(rest)))
        out += [packed_chunks(rest & (1 << width) - 1, width), bits.tobytes(), ranks.tobytes()]
        rest = more[going]
    shape.append((split[-1], len(rest)))
    out.append(packed_chunks(rest, split[-1]))
    return shape, b"".join(map(padded, out))


def file_of(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The file of these documents, each document's ids as little-endian unsigned 32-bit numbers."""
    counts = np.array([len(x) // 4 for x in ids], np.int64)
    shape, body = encoded(np.frombuffer(b"".join(ids), "<u4"))
    head = MAGIC + struct.pack("<IQQI", VERSION, len(ids), int(counts.sum()), len(shape)) + b"".join(struct.pack("<IQ", *x) for x in shape)
    docs = padded(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids))
    raw = padded(head) + docs + np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes() + body
    return raw + struct.pack("<I", zlib.crc32(raw))


class Level:
    """One level of a file: its entries' chunks, and, unless it is the last, which of them go on."""

    def __init__(self, raw: memoryview, at: int, width: int, n: int, last: bool):
        self.width, self.n, self.last = width, n, last
        size = (n * (width // 4) + 1) // 2
        self.chunks = np.frombuffer(raw, np.uint8, size, at)
        at += size + -size % 8
        if not last:
            size = (n + 7) // 8
            self.bits = np.frombuffer(raw, np.uint8, size, at)
            at += size + -size % 8
            size = (n + BLOCK - 1) // BLOCK + 1
            self.ranks = np.frombuffer(raw, "<u4", size, at)
            at += 4 * size + -4 * size % 8
        self.end = at

    def values(self, a: int, b: int) -> np.ndarray:
        """The chunks of entries a to b."""
        k = self.width // 4
        if k == 2:
            return self.chunks[a:b].astype(np.uint32)
        if k == 4:
            return self.chunks[2 * a : 2 * b].view("<u2").astype(np.uint32)
        some = self.chunks[a * k // 2 : (b * k + 1) // 2]
        nibbles = np.empty(2 * len(some), np.uint8)
        nibbles[::2], nibbles[1::2] = some & 15, some >> 4
        nibbles = nibbles[a * k % 2 :][: (b - a) * k]
        out = nibbles[::k].astype(np.uint32)
        for i in range(1, k):
            out |= nibbles[i::k].astype(np.uint32) << 4 * i
        return out

    def chunk(self, i: np.ndarray) -> np.ndarray:
        """The chunks of the entries i, whatever their order."""
        k, out = self.width // 4, np.zeros(len(i), np.uint32)
        for j in range(k):
            nibble = i * k + j
            out |= (self.chunks[nibble >> 1] >> (nibble & 1) * 4 & 15).astype(np.uint32) << 4 * j
        return out

    def goes_on(self, i: np.ndarray) -> np.ndarray:
        return (self.bits[i >> 3] >> (i & 7) & 1).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many entries before each of i go on: the directory, and what its own block has before it."""
        out = self.ranks[i // BLOCK].astype(np.int64)
        for k, at in enumerate(i.tolist()):
            block = self.bits[at // BLOCK * (BLOCK // 8) : (at >> 3) + 1]
            if at % BLOCK:
                out[k] += (int.from_bytes(block.tobytes(), "little") & (1 << at % BLOCK) - 1).bit_count()
        return out


class File:
    """A file that is read where it is asked."""

    def __init__(self, raw: bytes, verify: bool = True):
        if raw[:4] != MAGIC or verify and zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("not a file of directly addressable codes, or a damaged one")
        _, self.n_docs, self.n, levels = struct.unpack_from("<IQQI", raw, 4)
        at = 28 + 12 * levels
        shape = [struct.unpack_from("<IQ", raw, 28 + 12 * k) for k in range(levels)]
        at += -at % 8
        ids, nulls = np.frombuffer(raw, "<i8", self.n_docs, at), np.frombuffer(raw, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = [None if no else d for d, no in zip(ids.tolist(), nulls.tolist())]
        at += 9 * self.n_docs + -9 * self.n_docs % 8
        self.starts = np.frombuffer(raw, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels: list[Level] = []
        for k, (width, n) in enumerate(shape):
            self.levels.append(Level(raw, at, width, n, k + 1 == levels))
            at = self.levels[-1].end

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The ids at these positions of the file, one chunk of each level that an id reaches."""
        i, left = np.asarray(positions, np.int64), np.arange(len(positions))
        out, shift = np.zeros(len(i), np.uint32), 0
        for level in self.levels:
            out[left] |= level.chunk(i) << shift
            if level.last:
                break
            on = level.goes_on(i)
            left, i = left[on], level.rank(i[on])
            shift += level.width
            if not len(i):
                break
        return out

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids from a to b: the directory says where they lie in each level."""
        level = self.levels[0]
        out, where, shift = level.values(a, b), None, 0
        while not level.last and b > a:
            on = np.unpackbits(level.bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].view(bool)
            where = np.flatnonzero(on) if where is None else where[on]
            shift += level.width
            a = int(level.rank(np.array([a]))[0])
            b, level = a + len(where), self.levels[self.levels.index(level) + 1]
            out[where] |= level.values(a, b) << shift
        return out


class ByteIds:
    """Ids of texts by a byte-level tokenizers file whose pre-tokenizer lets a space begin a piece.

    A space or line end, alone or as one of two such characters before something
    else, parts pieces wherever it stands, and so does the change from a letter or
    digit to marks that end there. Texts therefore fall into stretches, of which an
    Arrow dictionary has each once, and whose ids are kept in a bounded cache of two
    generations. Latin letters are one piece, so many new ones are encoded as one
    text, parted at the ids that begin with a space or are a line end. Texts with
    longer runs of white space, with special tokens or with the control character
    that marks what has no space before it, and all texts of a file with a
    normaliser or another pre-tokenizer, or that fails a trial, are encoded whole.
    """

    #: Three characters of white space, or two at the end.
    SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    RUN = f"{SPACE}{SPACE}(?:{SPACE}|\\z)"
    BARE = "\x01"
    MARKS = r"([\p{L}\p{N}])([!-/:-@\[-`{-~]+)( |\n|\z)"
    LETTERS = re.compile(r"\x01?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+")
    TRIAL = "The quick-brown  Fox, jumps.\n\n ÀÉÎ õü ß \n over\tall lazy dogs' 3.14 e-mail, snake_case\nIt's don't: naïve; señor? (ªº) x1y2 漢字 αβ.  end "

    def __init__(self, path: str, cached: int = 400_000):
        from tokenizers import Tokenizer

        self.tok, self.cached = Tokenizer.from_file(path), cached
        vocabulary = self.tok.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for w, i in vocabulary.items() if w.startswith("Ġ")]] = True
        self.line = np.arange(len(self.begins)) == vocabulary.get("Ċ", -1)
        kind = json.loads(self.tok.to_str())
        self.special = [t["content"] for t in kind["added_tokens"]]
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        by_bytes = kind["normalizer"] is None and (kind["pre_tokenizer"] or {}).items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items()
        samples = [self.TRIAL, self.TRIAL.upper(), " ", "", "abc, ", " a, b. c", "\n a\nb"]
        self.by_stretches = by_bytes and self.begins.any() and self.line.any()
        self.by_stretches = self.by_stretches and self.ids(samples) == [self._whole(t) for t in samples]
        self.cache, self.old = {}, {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, key: str) -> str:
        return key[1:] if key.startswith(self.BARE) else key if key == "\n" else " " + key

    def _letters(self, keys: list[str], parted: str, cut: np.ndarray) -> None:
        """Keeps the ids of letters behind a space, or behind a line end, whose id is left out."""
        cache, step, skip = self.cache, 256, 4 * (parted == "\n")
        words = [k[1:] for k in keys] if skip else keys
        for k, e in enumerate(self.tok.encode_batch_fast([parted + parted.join(words[i : i + step]) for i in range(0, len(words), step)], add_special_tokens=False)):
            ids, some = np.array(e.ids, "<u4"), keys[k * step : (k + 1) * step]
            raw, cuts = ids.tobytes(), [*(np.flatnonzero(cut[ids]) * 4).tolist(), 4 * len(ids)]
            if len(cuts) == len(some) + 1 and not cuts[0]:
                cache.update((w, raw[a + skip : b]) for w, a, b in zip(some, cuts, cuts[1:]))
            else:
                cache.update((w, self._whole(self._plain(w))) for w in some)

    def _known(self, keys: list[str]) -> list[bytes]:
        """The ids of each stretch."""
        if len(self.cache) > self.cached:
            self.old, self.cache = self.cache, {}
        cache, old, match = self.cache, self.old, self.LETTERS.fullmatch
        new = [k for k in keys if k not in cache]
        cache.update((k, old[k]) for k in new if k in old)
        if old:
            new = [k for k in new if k not in old]
        letters = [k for k in new if match(k)]
        self._letters([k for k in letters if k[0] != self.BARE], " ", self.begins)
        self._letters([k for k in letters if k[0] == self.BARE], "\n", self.line)
        other = [k for k in new if not match(k)]
        for k, e in zip(other, self.tok.encode_batch_fast([self._plain(k) for k in other], add_special_tokens=False)):
            cache[k] = np.array(e.ids, "<u4").tobytes()
        return [cache[k] for k in keys]

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin, with the end."""
        if self.by_stretches and len(texts):
            odd = pc.match_substring_regex(texts, self.RUN)
            for part in (self.BARE, *self.special):
                odd = pc.or_(odd, pc.match_substring(texts, part))
        else:
            odd = pa.array([True] * len(texts), pa.bool_())
        keyed = pc.replace_substring_regex(pc.if_else(odd, "", texts), self.MARKS, r"\1 " + self.BARE + r"\2\3")
        keyed = pc.replace_substring(pc.binary_join_element_wise(self.BARE, keyed, ""), "\n", f" \n {self.BARE}")
        lists = pc.split_pattern(keyed, " ")
        stretches = lists.values.dictionary_encode()
        # No stretch has a space in it.
        known = self._known(pc.binary_join(pa.ListArray.from_arrays([0, len(stretches.dictionary)], stretches.dictionary), " ")[0].as_py().split(" "))
        flat, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        which = stretches.indices.to_numpy()
        size = sizes[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], size) + np.arange(ends[-1])]
        starts = ends[lists.offsets.to_numpy()]
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(at):
            return ids, starts
        whole = {i: np.frombuffer(self._whole(texts[i].as_py()), "<u4") for i in at.tolist()}
        parts = [whole[i] if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(starts[:-1], starts[1:]))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def ids(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        flat, at = self.arrays(pa.array(batch, pa.string()))
        return [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


_ids: dict[str, ByteIds] = {}

FILES = "part int, seq int, before long, n_docs int, n_tokens long, file binary"


def write_tokens(docs: DataFrame, path: str, end: int = 2, tokens: int = 1 << 18) -> DataFrame:
    """A written table of files, with the ids of all documents in ascending doc_id order, each document's followed by `end`.

    Documents are dealt by ranges of doc_id; part numbers the ranges, seq the files
    of a part, and before counts the ids of the part in earlier files. A file ends
    with the document that brings it to `tokens` ids, so no document is cut. A null
    or empty text is the end id alone, a null doc_id comes first. Rows of one doc_id
    stand together, by a hash of their texts, and may be dealt to several parts. A
    task holds a file and an Arrow batch.
    """
    spark = docs.sparkSession
    small_batches(spark, 4000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _ids:
            _ids[path] = ByteIds(path)
        task, last = TaskContext.get(), end.to_bytes(4, "little")
        part, seq, before, held = task.partitionId() if task else 0, 0, 0, 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []

        def row() -> pa.RecordBatch:
            values = [part, seq, before, len(ids), held, file_of(doc_ids, ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["part", "seq", "before", "n_docs", "n_tokens", "file"])

        for b in batches:
            flat, at = _ids[path].arrays(b.column(1))
            for doc, x, y in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                doc_ids.append(doc)
                ids.append(flat[x:y].tobytes() + last)
                held += y - x + 1
                if held >= tokens:
                    yield row()
                    seq, before, held, doc_ids, ids = seq + 1, before + held, 0, [], []
        if ids:
            yield row()

    rows = texts(docs).withColumn("_tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return written(dealt.mapInArrow(freed(run), FILES), "tokens", "none", **{"parquet.block.size": 16 << 20})


def with_starts(files: DataFrame) -> DataFrame:
    """files, and start, the ids of all documents in earlier files. The driver holds one number for each part, of which there are as many as shuffle partitions."""
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, n = [], 0
    for part in sorted(totals):
        starts.append((part, n))
        n += totals[part]
    table = F.broadcast(files.sparkSession.createDataFrame(starts or [(0, 0)], "part int, _start long"))
    return files.join(table, "part").withColumn("start", F.col("_start") + F.col("before")).drop("_start")


def read_documents(files: DataFrame, arrays: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files; with `arrays` also its ids."""
    small_batches(files.sparkSession, 16)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = File(raw)
                ids, at = memoryview(f.slice(0, f.n).astype("<u4").tobytes()), f.starts
                edges = (at * 4).tolist()
                columns = [pa.array(f.doc_ids, pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array([zlib.crc32(ids[x:y]) for x, y in zip(edges, edges[1:])], pa.int64())]
                if arrays:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(ids, "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return with_starts(files).select("start", "file").mapInArrow(freed(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * arrays)


def tokens_at(files: DataFrame, wanted: DataFrame, span: int = 1 << 18) -> DataFrame:
    """position, id of each distinct position of wanted that some document has. Files that none asks are not read, and of the others only the chunks asked for are put together."""
    small_batches(files.sparkSession, 16)
    plain = with_starts(files).select("part", "seq", "start", (F.col("start") + F.col("n_tokens")).alias("end"))
    spans = plain.withColumn("_span", F.explode(F.sequence(F.expr(f"start div {span}"), F.expr(f"(end - 1) div {span}"))))
    asked = wanted.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct().withColumn("_span", F.expr(f"position div {span}"))
    placed = asked.join(spans, "_span").where("position >= start and position < end").groupBy("part", "seq").agg(F.first("start").alias("start"), F.sort_array(F.collect_list("position")).alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, positions, raw in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                at = np.array(positions.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(File(raw, verify=False).at(at - start).astype(np.int64))], ["position", "id"])

    return placed.join(files.select("part", "seq", "file"), ["part", "seq"]).select("start", "positions", "file").mapInArrow(freed(run), "position long, id long")


def op11_token_codes(spark, sf_dir):
    import public_tokenizers

    return read_documents(write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
