"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation walks the model's compiled character map, a double-array trie in
front of a blob of replacements: at each place the longest key that is a prefix
of what remains is replaced, and each byte that comes out remembers the byte it
came from. Pieces are found in the normalised text, and that record projects
each of them to a span of bytes of the original.

No piece holds a word-start mark after another character, and none joins a
character that only byte fallback knows to another one. So a text falls apart
at those places into segments that encode independently, and a bounded cache of
segments spares the library most of the work. Where a vocabulary or a text
doesn't allow this, the whole text goes to the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, freed, small_batches, texts

MARK = "▁"


class CharMap:
    """The longest-prefix rewriting of a precompiled character map."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.out = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest key at that place."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.out[found[1] : self.out.index(b"\0", found[1])]

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The rewritten bytes, and for each of them and the end the place in raw that it came from."""
        if not self.units:
            return raw, np.arange(len(raw) + 1)
        out, at, i = bytearray(), [], 0
        while i < len(raw):
            hit = self.longest(raw, i)
            if hit:
                n, new = hit
            else:
                n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                new = raw[i : i + n]
            out += new
            at += [i] * len(new)
            i += n
        return bytes(out), np.array([*at, len(raw)], np.int64)


class Pieces:
    """A model, read once in a process. path: of a SentencePiece model file; or the serialised model itself."""

    def __init__(self, path: str | bytes, cached: int = 250_000):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        blob = path if isinstance(path, bytes) else open(path, "rb").read()
        self.sp = spm.SentencePieceProcessor(model_proto=blob)
        model = pb.ModelProto()
        model.ParseFromString(blob)
        spec = model.normalizer_spec
        self.charmap, self.prefix, self.squeeze = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
        kinds = [p.type for p in model.pieces]
        self.sizes = np.array([1 if k == 6 else len(p.piece.encode()) for p, k in zip(model.pieces, kinds)], np.int64)
        self.unknown = {i for i, k in enumerate(kinds) if k == 2}
        plain = [p.piece for p, k in zip(model.pieces, kinds) if k in (1, 4)]
        self.mark_id = self.sp.piece_to_id(MARK)
        self.segmented = (
            model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
            and 4 not in kinds and not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain) and self.mark_id not in self.unknown
        )
        self.cache: dict[str, tuple[bytes, str, int, bytes]] = {}
        self.cached = cached

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """What the library cuts into pieces, in UTF-8, and the byte of the text that each byte came from."""
        out, places = self.record(text)
        marked = out.replace(b" ", MARK.encode())
        return (MARK.encode() + marked if self.prefix and out else marked), places

    def record(self, text: str) -> tuple[bytes, np.ndarray]:
        """The text by the model's character map, and, for each byte of what is cut into pieces and for its end, the byte of the text that it came from: of a mark's three bytes the space's, of the mark in front the first byte."""
        out, at = self.charmap.normalise(text.encode())
        if self.squeeze:
            raw = np.frombuffer(out, np.uint8)
            blank = raw == 32
            keep = ~blank | np.concatenate([[False], ~blank[:-1]]) if len(raw) else np.zeros(0, bool)
            while len(keep) and blank[np.flatnonzero(keep)[-1]] if keep.any() else False:
                keep[np.flatnonzero(keep)[-1]] = False
            out, at = raw[keep].tobytes(), np.concatenate([at[:-1][keep], [at[np.flatnonzero(keep)[-1] + 1] if keep.any() else at[-1]]])
        if not out:
            return out, at
        wide = np.ones(len(out) + 1, np.int64)
        wide[:-1][np.frombuffer(out, np.uint8) == 32] = 3
        if self.prefix:
            wide[0] += 3
        return out, np.repeat(at, wide)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, byte after the last) of each piece, in bytes of the text."""
        ids = self.encode(text)
        if not ids:
            return []
        places = self.record(text)[1]
        if self.unknown.isdisjoint(ids):
            sizes = self.sizes[ids]
        else:  # an unknown piece is as long as what stands there
            sizes = [len(s.encode()) if i in self.unknown else int(self.sizes[i]) for i, s in zip(ids, self.sp.encode(text, out_type=str))]
        ends = np.cumsum(sizes)
        return [(i, int(places[e - s]), int(places[e])) for i, s, e in zip(ids, sizes, ends)]

    def encode(self, text: str) -> list[int]:
        if not self.segmented or MARK in text:
            return self.sp.encode(text)
        csv = b"".join(c[0] for c in self.segments([text])[0])
        return [int(x) for x in csv[:-1].split(b",")] if csv else []

    def _keys(self, text: str) -> list[str]:
        """Its segments: a word without the mark in front of it, or a line end and what follows."""
        if not text:
            return []
        s = text.replace("\n", " \n")
        if "  " in s or s[0] == " " or s[-1] == " ":
            return [x[1:] if x[0] == " " else x for x in re.findall(r" +[^ \n]*|\n[^ \n]*", f" {text}")]
        return s.split(" ")

    def segments(self, batch: list[str]) -> list[list[tuple[bytes, str, int, bytes]]]:
        """For each text its segments' ids (decimal, each followed by a comma), decoded text, number of ids, and bytes of each piece as it is cut."""
        keys = [self._keys(t) for t in batch]
        if len(self.cache) > self.cached:
            self.cache.clear()
        new = list(set().union(*keys) - self.cache.keys())
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids = self.sp.encode(part, num_threads=1)
            ids = [[self.mark_id] if not k else x[1:] if k[0] == "\n" else x for k, x in zip(part, ids)]
            for k, x, d in zip(part, ids, self.sp.decode(ids, num_threads=1)):
                if k[:1] != "\n":
                    d = " " + d
                self.cache[k] = (b"".join(b"%d," % y for y in x), d, len(x), self.sizes[x].astype("<u4").tobytes())
        get = self.cache.__getitem__
        return [list(map(get, ks)) for ks in keys]

    def digests(self, batch: list[str]) -> list[tuple[int, str, str, bytes]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text, where each piece ends in bytes of the text, as 32-bit numbers) of each text.

        The ends are read off the normaliser's record of the text: a piece of s bytes
        ends where the byte after it came from.
        """
        whole = [not self.segmented or MARK in t for t in batch]
        segments = iter(self.segments([t for t, w in zip(batch, whole) if not w]))
        out = []
        for text, w in zip(batch, whole):
            if w or not text:
                ids = self.sp.encode(text)
                csv, decoded, n = ",".join(map(str, ids)).encode(), self.sp.decode(ids), len(ids)
                ends = np.array([e for _, _, e in self.spans(text)], "<u4")
                if not w:
                    next(segments)
            else:
                a, b, c, d = zip(*next(segments))
                csv, decoded, n = b"".join(a)[:-1], "".join(b)[1:], sum(c)
                ends = self.record(text)[1][np.cumsum(np.frombuffer(b"".join(d), "<u4"))].astype("<u4")
            out.append((n, hashlib.sha256(csv).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ends.tobytes()))
        return out


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, span_ends (where each piece ends in bytes of the text, little-endian unsigned 32-bit; it begins where the one before ends), where each row lies.

    path: a model file that every executor has. A null or empty text has no ids and decodes to nothing.
    Repeated rows get equal results. A worker holds one Arrow batch and a bounded cache.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            rows = m.digests(b.column(1).to_pylist())
            n, ids, decoded, ends = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(ends, pa.binary())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_ends"])

    return texts(docs).mapInArrow(freed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_ends binary")


def piece_spans(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and pieces, an array of (id, begin, end): each piece of the text and its bytes there."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kind = model(path), pa.list_(pa.struct([("id", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[{"id": i, "begin": s, "end": e} for i, s, e in m.spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "pieces"])

    return texts(docs).mapInArrow(freed(run), "doc_id long, pieces array<struct<id int, begin long, end long>>")


def op7_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
