"""S-expressions, and the batch, inline and result files written in them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r'\s*(?:([()])|"((?:[^"\\]|\\.)*)"|([^\s()"]+))')


def parse(text: str) -> list:
    """All expressions of a text: lists and atoms."""
    stack: list[list] = [[]]
    at, end = 0, len(text.rstrip())
    while at < end:
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no token at {at}")
        at = m.end()
        if m[1] == "(":
            stack.append([])
        elif m[1] == ")":
            if len(stack) == 1:
                raise ValueError(f"unopened parenthesis at {at}")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(re.sub(r"\\(.)", r"\1", m[2]) if m[2] is not None else m[3])
    if len(stack) > 1:
        raise ValueError("unclosed parenthesis")
    return stack[0]


def dump(x) -> str:
    if isinstance(x, (list, tuple)):
        return "(" + " ".join(map(dump, x)) + ")"
    x = str(x)
    return x if re.fullmatch(r'[^\s()"\\]+', x) else '"' + re.sub(r'(["\\])', r"\\\1", x) + '"'


def record(x: list) -> dict:
    """A list of (name value) pairs, each name once."""
    out: dict = {}
    for pair in x:
        if not isinstance(pair, list) or len(pair) != 2 or pair[0] in out:
            raise ValueError(f"bad field {dump(pair)}")
        out[pair[0]] = pair[1]
    return out


BATCH = "path string, run int, l_path string, l_name string, l_addr long, r_path string, r_name string, r_addr long, error string"


def batch_rows(path: str, text: str) -> list[tuple]:
    """A row for each pair of a batch file, or one row with what is wrong with it."""
    try:
        out = []
        batch = record(parse(text)[0])
        for k, run in enumerate(batch["runs"]):
            r = record(run)
            binaries = [record(b)["path"] for b in r["binaries"]]
            for pair in r["inlines"]:
                p = record(pair)
                ends = [record(p[side]) for side in ("parent", "out_of_line_copy")]
                row = [x for e in ends for x in (binaries[int(e["binary_idx"])], e["name"], int(e["addr"], 0))]
                out.append((path, k, *row, None))
        return out
    except (ValueError, KeyError, IndexError, TypeError) as e:
        return [(path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]


def read_batches(spark: SparkSession, root: str, glob: str = "*.batch") -> DataFrame:
    """The pairs of all batch files below a folder. Files that can't be read give a row each with an error, so all of them show at once."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(_batches, BATCH)


def _batches(parts):
    import pandas as pd

    columns = [c.split()[0] for c in BATCH.split(", ")]
    for p in parts:
        rows = [x for path, text in zip(p["path"], p["value"]) for x in batch_rows(path, text)]
        yield pd.DataFrame(rows, columns=columns).astype({"run": "Int32", "l_addr": "Int64", "r_addr": "Int64"})


def write_batch(pairs: list[tuple]) -> str:
    """The text of a batch file with one run for each (left path, name, address, right path, name, address)."""
    runs = [[["binaries", [[["path", lp], ["parameters", []]], [["path", rp], ["parameters", []]]]], ["inlines", [[["parent", [["binary_idx", 0], ["name", ln], ["addr", hex(la)]]], ["out_of_line_copy", [["binary_idx", 1], ["name", rn], ["addr", hex(ra)]]]]]]] for lp, ln, la, rp, rn, ra in pairs]
    return dump([["version", 1], ["runs", runs]])


FUZZ, OVERLAP = r"(ExactOnly|SubsetAndExact|SupersetAndExact|\(Fuzzy \([^()]*\([^()]*\)\)\))", r"\((Overlap\w+) (\d+|\(\d+ \d+\))\)"
LINE = rf"^\(res \(classification {FUZZ} {OVERLAP}\) \(cluster ([^()]+)\) \(([^()]*)\) ([-VX])\)$"


def result_line(fuzz: Column, overlap: Column, cluster: Column, flags: Column, validated: Column) -> Column:
    return F.concat(F.lit("(res (classification "), fuzz, F.lit(" "), overlap, F.lit(") (cluster "), cluster, F.lit(") ("), flags, F.lit(") "), validated, F.lit(")"))


def parse_results(lines: DataFrame, line: str = "value") -> DataFrame:
    """Fields of result lines; a line of another form has all fields null but itself."""
    c = F.col(line)
    g = lambda k: F.when(c.rlike(LINE), F.regexp_extract(c, LINE, k))
    numbers = F.regexp_extract_all(g(3), F.lit(r"(\d+)"), F.lit(1))
    counts = F.split(F.regexp_extract(g(1), r"\(([0-9 ]+)\)\)\)$", 1), " ")
    return lines.select(
        c.alias("line"), F.regexp_extract(g(1), r"(\w+)", 1).alias("fuzz"), F.regexp_extract(g(1), r"\(Fuzzy \(([0-9.]+)", 1).try_cast("double").alias("mean"), F.regexp_replace(g(2), "^Overlap", "").alias("overlap"),
        numbers[0].cast("long").alias("n"), F.get(numbers, F.lit(1)).cast("long").alias("d"), g(4).alias("cluster"), F.split(g(5), " ").alias("flags"), g(6).alias("validated"),
        *[F.get(counts, F.lit(i)).try_cast("long").alias(n) for i, n in enumerate(("n_total", "n_partial", "n_sub", "n_sup"))],
    )


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """The distinct result lines of all overview files below a folder."""
    return parse_results(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "overview").text(root).distinct())
