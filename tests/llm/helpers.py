"""Small tables with the cases that every operator has to bear."""

import hashlib
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def sample(spark, n=None):
    """Rows of the smallest table, as (doc_id, text)."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()][:n]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("n_words", "kept", "_rk", "_text", "h", "pos", "start", "length", "score", "spans", "bucket"):
            df = df.withColumn(name, F.lit("x"))
    return df


ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (None, "no id at all here"),
    (5, "same row"),
    (5, "same row"),
    (6, "é ü ñ ▁ 漢字     \x00 \x1c x  y   z \n\n"),
    (7, "word " * 5000),
    (8, "a b c d e f\n" * 300),
    (9, "x" * 70000),
    (10, " lead and trail "),
]


def same_crc(first, second):
    """Two texts that begin as given, with one CRC-32."""
    import zlib

    ends = [sha(str(i))[:12] for i in range(300_000)]
    start = zlib.crc32(f"{first} ".encode()), zlib.crc32(f"{second} ".encode())
    seen = {zlib.crc32(e.encode(), start[0]): e for e in ends[:150_000]}
    end = next(e for e in ends if zlib.crc32(e.encode(), start[1]) in seen)
    return f"{first} {seen[zlib.crc32(end.encode(), start[1])]}", f"{second} {end}"
