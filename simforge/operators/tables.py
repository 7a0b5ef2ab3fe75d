"""Written intermediate tables, by which iterations cut their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a temporary one, which only a session on this machine alone can do with."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="simforge-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at, True)
    return at.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that a lost executor doesn't undo earlier rounds. settled_at is its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def unsettle(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t.settled_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Grown:
    """A table that rounds add to. Each round is settled; every so many are put together, so that reading takes few files."""

    MANY = 12

    def __init__(self, first: DataFrame):
        self.rounds = [settled(first)]

    def last(self) -> DataFrame:
        return self.rounds[-1]

    def all(self) -> DataFrame:
        spark, first = self.rounds[0].sparkSession, self.rounds[0]
        return spark.read.schema(first.schema).parquet(*[t.settled_at for t in self.rounds])

    def add(self, rows: DataFrame) -> bool:
        """Whether there are any rows."""
        new = settled(rows)
        if new.isEmpty():
            unsettle(new)
            return False
        if len(self.rounds) == self.MANY:
            old, self.rounds = self.rounds, [settled(self.all())]
            unsettle(*old)
        self.rounds.append(new)
        return True


def fixpoint(state: DataFrame, step) -> DataFrame:
    """Repeats step(what the last round added), which gives rows to add, until there are none. Rows are distinct, so finitely many possible rows bound the rounds. The result's files stay; those of rounds are put together."""
    grown = Grown(state.distinct())
    while grown.add(step(grown.last()).distinct().join(grown.all(), state.columns, "left_anti")):
        pass
    return grown.all()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to as many tasks as a shuffle has, for work that is much more than its bytes: a file of one row group is one task otherwise. A number of its own, so that small parts aren't put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def by_key(df: DataFrame, order: list[str], f: Callable, schema: str, types: dict[str, pa.DataType]) -> DataFrame:
    """f(key, rows) gives the result rows of each key: the value of the first column of df, and all of its rows as tuples in the given order.

    Keys come sorted in Arrow batches, so a Python call serves many small keys and
    holds one key's rows. types: the Arrow types of the result's columns.
    """
    key = df.columns[0]
    # A number of its own, as few bytes may be much work in Python, which must not be put together in one task. By a hash of the
    # key, as Spark leaves out a shuffle by a column that the plan below claims to be dealt by, and then may read that plan's
    # shuffles otherwise than it was planned, with one key in several partitions.
    ordered = spread(df, key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types.values())], list(types))

        now, held, rows = None, [], []
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if held and r[0] != now:
                    rows.extend(f(now, held))
                    held = []
                now = r[0]
                held.append(r)
            if len(rows) > 5_000:
                yield out(rows)
                rows = []
        if held:
            rows.extend(f(now, held))
        yield out(rows)

    return ordered.mapInArrow(run, schema)
