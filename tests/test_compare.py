"""Batches, block clusters and readers on small tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from simforge.operators import batches as B
from simforge.operators import blocks as K
from simforge.operators import classify as C
from simforge.sources import files, sinks


def result(fuzz, overlap=None, n=None, d=None, mean=None, counts=(0, 0, 0, 0)):
    return fuzz, overlap, n, d, mean, *counts


#: Results from the least to the greatest.
ORDER = [
    result(None), result("Fuzzy", "Total", 9, 9, 0.25, (4, 2, 0, 0)), result("Fuzzy", "Total", 1, 9, 0.5, (2, 1, 0, 0)), result("Fuzzy", "Partial", 1, 9, 0.5, (4, 1, 0, 0)), result("Fuzzy", "Partial", 1, 9, 0.5, (4, 2, 0, 0)),
    result("SubsetAndExact", "Partial", 1, 3), result("SupersetAndExact", "Partial", 1, 2), result("SubsetAndExact", "Superset", 2, 5), result("SupersetAndExact", "Subset", 3, 5), result("SubsetAndExact", "Total", 1, 1),
    result("ExactOnly", "Partial", 0, 4), result("ExactOnly", "Partial", 3, 4), result("ExactOnly", "Subset", 1, 4), result("ExactOnly", "Total", 2, 2), result("ExactOnly", "Total", 3, 3),
]
SCHEMA = "i int, fuzz string, overlap string, n long, d long, mean double, n_total long, n_partial long, n_sub long, n_sup long"


def test_order_of_results(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ORDER)], SCHEMA)
    assert [r.i for r in df.orderBy(C.sort_key()).collect()] == list(range(len(ORDER)))
    two = df.where("i in (0, 3)").withColumn("key", F.lit(1))
    assert C.best(two, "key", "i").first().i == 3
    status = C.compare_runs(df.where("i = 7").withColumn("key", F.lit(1)), df.where("i = 0").withColumn("key", F.lit(1)), "key").first().status
    assert status == "worse"


def test_failed_results_have_no_class(spark):
    df = spark.createDataFrame([(None, None, None, None, None, 3, 4), (4, 1, 0, 0, 3, 3, 4)], "n_total long, n_partial long, n_sub long, n_sup long, n long, s1 long, s2 long")
    got = C.classified(df).orderBy("n").collect()
    assert (got[0].fuzz, got[0].overlap, got[0].d) == (None, None, None) and (got[1].fuzz, got[1].overlap) == ("Fuzzy", "Subset")


def test_names(spark):
    df = spark.createDataFrame([("a-gcc-1.2.3-O2-f",), ("a-gcc-1.2.3-O2",), (None,)], "k string")
    got = [r.x and r.x.path for r in df.select(B.of_key(F.col("k")).alias("x")).collect()]
    assert got == ["gcc-1.2.3-a-O2", None, None]
    one = spark.createDataFrame([("p-q-f-ff",), ("f-zz",)], "k string").select(B.last_fields(F.col("k")).alias("x")).collect()
    assert tuple(one[0].x) == ("p-q", "f", 255) and one[1].x is None
    d = spark.createDataFrame([("é" * 200, 4096)], "s string, a long").select(B.function_dir(F.col("s"), F.col("a")).alias("d")).first().d
    assert len(d.encode("utf-8", "replace")) <= 252 and d.endswith("-1000")
    with pytest.raises(ValueError):
        B.by_version(df, "minor")


def test_plans_are_checked(spark):
    plan = spark.createDataFrame([(1, "a")], "k int, p string")
    assert B.enriched(spark.createDataFrame([(1,)], "k int"), plan, "k").first().p == "a"
    with pytest.raises(PySparkException, match="not planned"):
        B.enriched(spark.createDataFrame([(2,)], "k int"), plan, "k").collect()
    with pytest.raises(PySparkException, match="two calls"):
        B.call_sites(spark.createDataFrame([(1, 2, "a"), (1, 2, "b")], "func int, site int, callee string")).collect()
    with pytest.raises(PySparkException, match="add up"):
        C.checked_total(spark.createDataFrame([(1, 3)], "g int, n_all long"), plan).collect()
    with pytest.raises(PySparkException, match="two ends"):
        C.function_ranges(spark.createDataFrame([(1, 2, "a"), (1, 3, "b")], "start int, end int, name string")).collect()


def test_classifiers(spark):
    with pytest.raises(ValueError, match="no classifier"):
        K.classify("nothing")

    @K.classifier("parity")
    def parity():
        return F.array((F.col("n_outputs") % 2).cast("string"))

    b = spark.createDataFrame([(1, 0, 3), (1, 1, None), (1, 2, 4)], "graph int, block int, n_outputs int")
    assert {(r.key, r.block) for r in K.block_clusters(b, "parity").collect()} == {("1", 0), ("0", 2)}
    assert K.representatives(K.block_clusters(b, "cardinality")).count() == 2
    del K.CLASSIFIERS["parity"]


def test_visibility_on_a_loop(spark):
    edges = spark.createDataFrame([("g", 0, 1, None), ("g", 1, 1, True), ("g", 1, 2, False)], "graph string, src int, dst int, label boolean")
    defs = spark.createDataFrame([("g", "a", 0), ("g", "b", 1), ("g", "c", 2), ("g", "d", 1)], "graph string, var string, block int")
    uses = spark.createDataFrame([("g", "a", 2), ("g", "b", 1), ("g", None, 1)], "graph string, var string, block int")
    seen = lambda **k: {r.var for r in K.visible_outputs(edges, defs, uses, **k).where("is_visible").collect()}
    assert seen() == {"a"}
    assert seen(carried=spark.createDataFrame([("g", "b", 1)], "graph string, var string, block int")) == {"a", "b"}
    assert seen(result="c") == {"a", "c"}
    assert seen(conditions=spark.createDataFrame([("g", "d", 1)], "graph string, var string, block int")) == {"a", "d"}


def test_inline_files(spark, tmp_path):
    (tmp_path / "a.inlines").write_text("((binary /bin/x) (inlines (((caller ((name f) (range ((0x10 0x20))))) (inline ((name g) (range ((1 2))))) (callees ((ranges (((0x30 0x40)))))))))) ")
    (tmp_path / "b.inlines").write_text("((binary")
    rows = sorted(files.read_inlines(spark, str(tmp_path)).collect(), key=lambda r: r.error is not None)
    assert (rows[0].binary, rows[0].caller_ranges[0].lo, rows[0].callee_ranges[0][0].hi) == ("/bin/x", 16, 64) and rows[1].error
    pairs, starts = B.of_inlines(files.read_inlines(spark, str(tmp_path)).where("error is null"))
    assert tuple(pairs.first()) == ("/bin/x", "f", 16, "g", 48) and starts.first().addr == 16


def test_store_executables_and_modules(spark, tmp_path):
    store = files.KeyedStore(spark, str(tmp_path / "kv"))
    assert store.get(1) is None
    store.put(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    store.put(spark.createDataFrame([(1, "c")], "id int, v string"))
    assert sorted(r.v for r in store.get(1).collect()) == ["a", "c"] and store.get(9).collect() == []
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/one").write_bytes(b"\x7fELF" + bytes(100))
    (tmp_path / "bin/two").write_bytes(b"#!/bin/sh")
    assert [r.name for r in files.read_executables(spark, str(tmp_path / "bin")).collect()] == ["one"]
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ml").write_text('let x = debug_module "match"\nlet y = 1')
    assert [r.module for r in files.read_debug_modules(spark, str(tmp_path / "src")).collect()] == ["match"]
    a = spark.createDataFrame([("x", 5), ("y", 5)], "name string, modified int")
    assert {r.name for r in files.stale(spark.createDataFrame([("x", 9)], "name string, modified int"), a).collect()} == {"y"}


def test_lines_and_status(spark, tmp_path, capsys):
    sinks.write_lines(spark.createDataFrame([("one",)], "v string"), None)
    assert capsys.readouterr().out == "one\n"
    sinks.write_lines(spark.createDataFrame([("one",)], "v string"), str(tmp_path / "out"))
    sinks.write_lines(spark.createDataFrame([("two",)], "v string"), str(tmp_path / "out"), append=True)
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    sinks.job_status(spark, "j", True, 1.5, str(tmp_path / "status"))
    assert spark.read.parquet(str(tmp_path / "status")).first().status == "success!"
