"""Verdicts, completion logs, configurations, symbol tables, binaries and command-line specifications."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _below(spark: SparkSession, root: str, glob: str):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """cluster, verdict of lines such as `key: verdict`. Any other line ends the job."""
    v, pattern = F.col("value"), r"^([^:\s]+): (.+)$"
    checked = F.when(v.rlike(pattern), v).otherwise(F.raise_error(F.concat(F.lit("malformed verdict: "), v)))
    return spark.read.text(path).select(F.regexp_extract(checked, pattern, 1).alias("cluster"), F.regexp_extract(checked, pattern, 2).alias("verdict"))


def read_completion(spark: SparkSession, root: str) -> DataFrame:
    """dir, completed: whether the folder's log is the single line that says so."""
    t = _below(spark, root, "result.log").text(root, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return t.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), (F.regexp_replace("value", r"\s+$", "") == "success!").alias("completed"))


def single_file(spark: SparkSession, root: str, name: str) -> str:
    """The path of the one file with this name below a folder; an error if there are none or more."""
    found = [r.path for r in _below(spark, root, name).format("binaryFile").load(root).select("path").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} files named {name}")
    return found[0]


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """binary, symbol, addr of text symbols in listings; a symbol that a binary has twice ends the job."""
    p = r"^([0-9a-fA-F]+) T (\S+)$"
    t = spark.read.text(path).where(F.col("value").rlike(p)).select(F.input_file_name().alias("binary"), F.regexp_extract("value", p, 2).alias("symbol"), F.conv(F.regexp_extract("value", p, 1), 16, 10).cast("long").alias("addr"))
    g = t.groupBy("binary", "symbol").agg(F.count("*").alias("n"), F.min("addr").alias("addr"))
    return g.select("binary", "symbol", F.when(F.col("n") == 1, F.col("addr")).otherwise(F.raise_error(F.concat(F.lit("symbol twice: "), "symbol"))).alias("addr"))


def read_executables(spark: SparkSession, root: str) -> DataFrame:
    """name, path of files that begin as ELF does; a base name of two files ends the job. Of each file four bytes are read, whatever its size."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(name) as f:
                    if f.read(4) == b"\x7fELF":
                        found.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])

    t = paths.mapInArrow(run, "path string").select("path", F.substring_index("path", "/", -1).alias("name"))
    g = t.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return g.select("name", F.when(F.col("n") == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("name twice: "), "name"))).alias("path"))


def stale(derived: DataFrame, binaries: DataFrame) -> DataFrame:
    """name of binaries (name, modified) whose derived table (name, modified) is missing or older."""
    d = derived.groupBy("name").agg(F.max("modified").alias("_d"))
    return binaries.join(d, "name", "left").where("_d is null or _d < modified").select("name")


def modified(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """name, modified of the files below a folder."""
    return _below(spark, root, glob).format("binaryFile").load(root).select(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("name"), F.col("modificationTime").alias("modified"))


def read_debug_modules(spark: SparkSession, root: str, glob: str = "*.ml", pattern: str = r'debug_module\s+"([^"]+)"') -> DataFrame:
    """module, path of the debugging modules that source files name."""
    t = _below(spark, root, glob).text(root).select(F.input_file_name().alias("path"), F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("module"))
    return t.select("module", "path").distinct()


INLINES = "binary string, caller string, caller_ranges array<struct<lo:bigint,hi:bigint>>, inline string, callee_ranges array<array<struct<lo:bigint,hi:bigint>>>, error string"


def read_inlines(spark: SparkSession, root: str, glob: str = "*.inlines") -> DataFrame:
    """The inlined instances that the files below a folder list; a file that can't be read gives one row, with the error."""
    return _below(spark, root, glob).text(root, wholetext=True).select("value").mapInPandas(_inlines, INLINES)


def _inlines(parts):
    import pandas as pd

    from .sexp import parse, record

    def spans(x):
        return [{"lo": int(lo, 0), "hi": int(hi, 0)} for lo, hi in x]

    for p in parts:
        rows = []
        for text in p["value"]:
            try:
                info = record(parse(text)[0])
                for one in info["inlines"]:
                    r = {k: record(v) for k, v in record(one).items()}
                    rows.append((info["binary"], r["caller"]["name"], spans(r["caller"]["range"]), r["inline"]["name"], [spans(x) for x in r["callees"]["ranges"]], None))
            except (ValueError, KeyError, IndexError, TypeError) as e:
                rows.append((None, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["binary", "caller", "caller_ranges", "inline", "callee_ranges", "error"])


class KeyedStore:
    """A table of rows by id that is added to: what was put under an id stays, and more may follow."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, df: DataFrame, key: str = "id") -> None:
        df.write.mode("append").partitionBy(key).parquet(self.path)

    def get(self, value, key: str = "id") -> DataFrame | None:
        """All rows of an id, none for an id that has none; None if nothing was ever put."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(self.path).where(F.col(key) == F.lit(value))


def paths_by_name(subjects: DataFrame, path: str = "path") -> DataFrame:
    """name, path of the files that subjects lie in; one name may stand for one path only."""
    g = subjects.groupBy(F.substring_index(path, "/", -1).alias("name")).agg(F.count_distinct(path).alias("n"), F.min(path).alias("path"))
    return g.select("name", F.when(F.col("n") == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("two paths: "), "name"))).alias("path"))


def parse_spec(spec: Column) -> Column:
    """`path[,key=v1:v2]...` as path and a map of lists; any key but funcs is an error."""
    parts = F.split(spec, ",")
    pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.split(F.substring_index(x, "=", -1), ":").alias("v")))
    ok = F.forall(pairs, lambda x: x["k"] == "funcs")
    return F.when(ok, F.struct(parts[0].alias("path"), F.map_from_entries(pairs).alias("parameters"))).otherwise(F.raise_error(F.concat(F.lit("unknown key in "), spec)))


def wanted_functions(funcs: DataFrame, names: list[str]) -> DataFrame:
    """funcs (start, symbols) by names and by addresses, which begin with 0; an empty list keeps all."""
    if not names:
        return funcs
    addresses = [int(x, 0) for x in names if x.startswith("0")]
    words = [x for x in names if not x.startswith("0")]
    return funcs.where(F.col("start").isin(addresses) | F.arrays_overlap("symbols", F.array(*[F.lit(w) for w in words]).cast("array<string>")))


class ConfigError(ValueError):
    """What is wrong with a configuration, and where."""


def _unique(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise ConfigError(f"key twice: {k}")
        out[k] = v
    return out


def _need(x, key, kind, where):
    if not isinstance(x, dict):
        raise ConfigError(f"{where}: not an object")
    if key not in x:
        raise ConfigError(f"{where}: no {key}")
    if not isinstance(x[key], kind):
        raise ConfigError(f"{where}.{key}: wrong type")
    return x[key]


def parse_config(text: str) -> dict[str, list[tuple]]:
    """compilers (name, major, minor, patch), primitives (name, implementation) and parameters (name, value, format) of a JSON configuration. Keys that stand twice, are missing, or have a value of another type are errors."""
    try:
        c = json.loads(text, object_pairs_hook=_unique)
    except json.JSONDecodeError as e:
        raise ConfigError(str(e)) from e
    compilers, primitives, parameters = [], [], []
    for i, x in enumerate(_need(c, "compilers", list, "config")):
        for k, v in enumerate(_need(x, "versions", list, f"compilers[{i}]")):
            compilers.append((_need(x, "name", str, f"compilers[{i}]"), *(str(_need(v, part, (int, str), f"compilers[{i}].versions[{k}]")) for part in ("major", "minor", "patch"))))
    for i, x in enumerate(_need(c, "primitives", list, "config")):
        for impl in _need(x, "implementations", list, f"primitives[{i}]"):
            if not isinstance(impl, str):
                raise ConfigError(f"primitives[{i}].implementations: wrong type")
            primitives.append((_need(x, "name", str, f"primitives[{i}]"), impl))
    for name, x in c.get("available_parameters", {}).items():
        for v in _need(x, "space", list, name):
            parameters.append((name, str(v), _need(x, "descr_fmt", str, name)))
    return {"compilers": compilers, "primitives": primitives, "parameters": parameters}


def config_tables(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    c = parse_config(text)
    return {
        "compilers": spark.createDataFrame(c["compilers"], "name string, major string, minor string, patch string"),
        "primitives": spark.createDataFrame(c["primitives"], "name string, implementation string"),
        "parameters": spark.createDataFrame(c["parameters"], "name string, value string, descr_fmt string"),
    }


def sweep(tables: dict[str, DataFrame]) -> DataFrame:
    """Subjects of a parameter sweep: compilers at patch 0, primitives and their implementations, each parameter value put in for @."""
    values = tables["parameters"].select(F.replace("descr_fmt", F.lit("@"), F.col("value")).alias("descr"))
    compilers = tables["compilers"].where("patch = '0'").select(F.col("name").alias("compiler"), F.concat_ws(".", "major", "minor", "patch").alias("version"))
    # The configuration is a few lines; its product is the plan of what to run.
    return compilers.join(tables["primitives"].withColumnRenamed("name", "prim")).join(values).select("compiler", "version", "prim", "implementation", "descr")


def inlined(dies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(with callees, without): out-of-line copies and expansions (origin, kind, name, lo, hi) by their origin."""
    g = dies.groupBy("origin").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "copy", F.struct("name", "lo", "hi")))).alias("callees"), F.array_sort(F.collect_list(F.when(F.col("kind") == "expansion", F.struct("name", "lo", "hi")))).alias("expansions"))
    g = g.where(F.size("expansions") > 0)
    return g.where(F.size("callees") > 0), g.where(F.size("callees") == 0)
