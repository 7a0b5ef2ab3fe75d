"""Writers of results, reports and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sexp import result_line


def append_results(df: DataFrame, path: str) -> None:
    """Result lines of df (fuzz_text, overlap_text, cluster, flags, validated) after those that are there."""
    df.select(result_line(F.col("fuzz_text"), F.col("overlap_text"), F.col("cluster"), F.concat_ws(" ", "flags"), F.col("validated"))).write.mode("append").text(path)


def fan_out(df: DataFrame, path: str, *by: str) -> None:
    """A folder for each value of the given columns; rows of one go to few files, and a value on very many rows to several."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def cluster_report(df: DataFrame, path: str, key: str, name: str) -> None:
    g = df.groupBy(key, name).agg(F.count("*").alias("n"))
    g.select(F.format_string("%s %s %d elements", F.col(key).cast("string"), F.col(name).cast("string"), "n")).write.mode("overwrite").text(path)


def coverage_report(df: DataFrame, path: str) -> None:
    """Functions analysed, failed by reason (null: none), of a program (prog, reason)."""
    g = df.groupBy("prog", "reason").agg(F.count("*").alias("n"))
    whole = g.groupBy("prog").agg(F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("ok"), F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat(F.lit("("), "reason", F.lit(" "), F.col("n").cast("string"), F.lit(")"))))), " ").alias("why"))
    whole.select(F.format_string("(%s %d %d (%s))", "prog", "ok", "total", "why")).write.mode("overwrite").text(path)


def tab_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def snapshots(passes: DataFrame) -> DataFrame:
    """func, no, name, changed, cfg_changed: what each pass did to a function, from snapshots (func, no, name, stmts_hash, edges_hash)."""
    from pyspark.sql import Window

    w = Window.partitionBy("func").orderBy("no")
    differs = lambda c: F.lag(c).over(w).isNotNull() & (F.lag(c).over(w) != F.col(c))
    return passes.select("func", "no", "name", differs("stmts_hash").alias("changed"), differs("edges_hash").alias("cfg_changed"))


def write_lines(df: DataFrame, path: str | None, append: bool = False) -> None:
    """The one text column of df to a folder, or, without one, to standard output."""
    if path is not None:
        df.write.mode("append" if append else "overwrite").text(path)
        return
    for r in df.toLocalIterator():
        print(r[0])


def batch_files(pairs: DataFrame, path: str) -> None:
    """Batch files under the paths that pairs name (batch, l_path, symbol, l_addr, r_path, r_addr): a folder for each, with one row to a run."""
    from .sexp import write_batch

    columns = ["batch", "l_path", "symbol", "l_addr", "r_path", "r_addr"]

    def run(parts):
        import pandas as pd

        for p in parts:
            texts = [write_batch([(r.l_path, r.symbol, int(r.l_addr), r.r_path, r.symbol, int(r.r_addr))]) for r in p.itertuples(index=False)]
            yield pd.DataFrame({"value": texts, "batch": p["batch"]})

    fan_out(pairs.select(*columns).mapInPandas(run, "value string, batch string"), path, "batch")


def job_status(spark, name: str, success: bool, seconds: float, path: str) -> None:
    """A row on how a job ended, after those that are there."""
    spark.createDataFrame([(name, "success!" if success else "failed", float(seconds))], "job string, status string, seconds double").write.mode("append").parquet(path)


def pass_snapshots(stmts: DataFrame) -> DataFrame:
    """func, no, name, stmts_hash, edges_hash after each pass of a function; the last row of a confusing one is of the pass before."""
    import hashlib

    from ..operators.passes import pipeline, run_passes
    from ..operators.programs import per_function

    def digest(texts) -> int:
        return int.from_bytes(hashlib.blake2b(f"[{', '.join(texts)}]".encode(), digest_size=8).digest(), "little", signed=True)

    def run(f):
        out = []
        # Most passes leave most statements as they are: the text of each is made once, and known by its id as long as it is kept.
        known: dict[int, tuple] = {}

        def text(s) -> str:
            if id(s) not in known:
                known[id(s)] = repr(s), s
            return known[id(s)][0]

        for no, one in enumerate(pipeline()):
            if run_passes(f, [one])[1]:
                break
            out.append((no, one[0], digest(f"({v}, {i}, {text(s)})" for v, i, s in f.statements()), digest(sorted(map(repr, f.edges)))))
        return out

    return per_function(stmts, run, "no int, name string, stmts_hash long, edges_hash long")
