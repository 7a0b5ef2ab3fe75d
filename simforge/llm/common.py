"""What the text operators share: input columns, row keys, written intermediate tables, Arrow settings."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word, as a Java and as a Python pattern class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once: few rows to an Arrow batch, and few bytes where Spark can count them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception:  # noqa: BLE001  an older Spark has no such setting
        pass


def freed(run):
    """run, an iterator over Arrow batches, which gives free memory back to the system when a task ends: workers wait for further tasks beside the executor's heap."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, as in tests, a temporary one, which only a session on this machine alone can do with."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="simforge-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(__import__("shutil").rmtree, at, True)
    return at.rstrip("/")


#: Paths of written tables, in order, of this process.
_paths: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """A set of tables to keep. At the end, all other tables that were written meanwhile are deleted."""
    before, keep = len(_paths), set()
    try:
        yield keep
    finally:
        for path in _paths[before:]:
            if path not in {t.written_at for t in keep}:
                delete(spark, path)
        del _paths[before:]
        _paths.extend(t.written_at for t in keep)


def written(df: DataFrame, name: str, codec: str = "zstd", **options) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts lineage and outlives executors. options are the writer's."""
    spark = spark_of(df)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    df.write.options(compression=codec, **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.written_at)


def release(spark: SparkSession) -> None:
    """Deletes the shuffle files of frames that are done with: they go when the driver's garbage is collected, which may otherwise be long after."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session that holds for the jobs run meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts empty: further columns, whatever their names, can't clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def row_key() -> Column:
    """Identifies a row by doc_id and text. Rows that agree in both get the same results, so repeated rows need no numbering."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text"))))


def spaced(text: Column) -> Column:
    """text with every character that ends a word as a space."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Cut at single spaces, which takes no regular expression."""
    return F.array_remove(F.split(spaced(text), " "), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches, least: int = 20_000):
    """Arrow tables of rows that come sorted by their first column, each group of it in one table; a table has `least` rows or one group, unless it is the last."""
    import numpy as np
    import pyarrow as pa

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(0).to_numpy()
        other = np.flatnonzero(k != k[-1])
        if len(other):
            cut = int(other[-1]) + 1
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
