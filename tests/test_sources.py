import pytest
from pyspark.sql import functions as F

from simforge.sources import files, sexp, sinks
from simforge.streaming.results import best_so_far, result_stream, windowed_counts

LINES = [
    "(res (classification ExactOnly (OverlapTotal 4)) (cluster a--b) (FIdenticalFunctions) -)",
    "(res (classification ExactOnly (OverlapPartial (3 4))) (cluster a--b) () V)",
    "(res (classification (Fuzzy (0.75 (4 1 1 2))) (OverlapSubset 2)) (cluster c--d) (FIsomorphicVanilla) X)",
    "not a result",
]


def test_sexp():
    assert sexp.parse('(a (b "c d") ())') == [["a", ["b", "c d"], []]]
    assert sexp.parse(sexp.dump(["x", ['q "', []]])) == [["x", ['q "', []]]]
    for bad in ("(", ")", '("'):
        with pytest.raises(ValueError):
            sexp.parse(bad)


def test_batches(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.batch").write_text(sexp.write_batch([("l.bin", "f", 16, "r.bin", "g h", 32)]))
    (tmp_path / "b.batch").write_text("(oops")
    rows = sorted(sexp.read_batches(spark, str(tmp_path)).collect(), key=lambda r: r.error or "")
    assert rows[0][2:8] == ("l.bin", "f", 16, "r.bin", "g h", 32) and rows[0].error is None and "unclosed" in rows[1].error


def test_results(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/overview").write_text("\n".join([*LINES, LINES[0]]) + "\n")
    got = {r.line: r for r in sexp.read_results(spark, str(tmp_path)).collect()}
    assert len(got) == 4
    a, b, c, d = (got[x] for x in LINES)
    assert (a.fuzz, a.overlap, a.n, a.d, a.cluster, a.flags, a.validated) == ("ExactOnly", "Total", 4, None, "a--b", ["FIdenticalFunctions"], "-")
    assert (b.overlap, b.n, b.d) == ("Partial", 3, 4) and (c.fuzz, c.mean, c.overlap) == ("Fuzzy", 0.75, "Subset") and d.fuzz is None


def test_stream(spark, tmp_path):
    (tmp_path / "overview").write_text("\n".join(LINES) + "\n")
    q = best_so_far(result_stream(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("best").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.cluster: r.overlap for r in spark.table("best").collect()} == {"a--b": "Total", "c--d": "Subset"}


def test_windowed_counts(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert windowed_counts(e, "ts", "event_type").agg(F.sum("n")).first()[0] == e.count()


def test_files(spark, tmp_path):
    (tmp_path / "v").write_text("a--b: identical\nc--d: differ at 3\n")
    assert files.read_verdicts(spark, str(tmp_path / "v")).count() == 2
    (tmp_path / "w").write_text("malformed\n")
    with pytest.raises(Exception, match="malformed verdict"):
        files.read_verdicts(spark, str(tmp_path / "w")).collect()
    for d, text in (("ok", "success!\n"), ("bad", "success!\nmore\n")):
        (tmp_path / "runs" / d).mkdir(parents=True)
        (tmp_path / "runs" / d / "result.log").write_text(text)
    assert {r.dir.rpartition("/")[2]: r.completed for r in files.read_completion(spark, str(tmp_path / "runs")).collect()} == {"ok": True, "bad": False}
    (tmp_path / "sym").write_text("00001000 T main\n00001010 t local\n00001020 T other\n")
    assert {r.symbol: r.addr for r in files.read_symbols(spark, str(tmp_path / "sym")).collect()} == {"main": 4096, "other": 4128}
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/prog").write_bytes(b"\x7fELFxxxx")
    (tmp_path / "bin/text").write_bytes(b"hello")
    assert [r.name for r in files.read_executables(spark, str(tmp_path / "bin")).collect()] == ["prog"]
    assert files.single_file(spark, str(tmp_path / "bin"), "prog").endswith("prog")
    with pytest.raises(ValueError):
        files.single_file(spark, str(tmp_path), "nothing")
    spec = spark.createDataFrame([("p,funcs=a:b",), ("q",)], "s string").select(files.parse_spec(F.col("s")).alias("x")).select("x.*").collect()
    assert (spec[0].path, spec[0].parameters, spec[1].parameters) == ("p", {"funcs": ["a", "b"]}, {})


CONFIG = '{"compilers": [{"name": "gcc", "versions": [{"major": 4, "minor": "9", "patch": 0}, {"major": 4, "minor": 9, "patch": 1}]}], "primitives": [{"name": "p", "implementations": ["i", "j"]}], "available_parameters": {"n": {"space": [1, 2], "descr_fmt": "n@"}}}'


def test_config(spark):
    t = files.config_tables(spark, CONFIG)
    assert t["compilers"].count() == 2 and files.sweep(t).count() == 4
    for bad, why in ((CONFIG.replace('"primitives"', '"compilers"'), "twice"), ("{}", "no compilers"), (CONFIG.replace('"gcc"', "3"), "wrong type"), ("{", "")):
        with pytest.raises(files.ConfigError, match=why):
            files.parse_config(bad)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("ExactOnly", "(OverlapTotal 2)", "a--b", ["FIdenticalFunctions"], "-")], "fuzz_text string, overlap_text string, cluster string, flags array<string>, validated string")
    for _ in range(2):
        sinks.append_results(df, str(tmp_path / "o"))
    back = sexp.parse_results(spark.read.text(str(tmp_path / "o")))
    assert [(r.fuzz, r.n, r.cluster) for r in back.collect()] == [("ExactOnly", 2, "a--b")] * 2
    sinks.fan_out(df.withColumn("status", F.lit("validated")), str(tmp_path / "f"), "status")
    assert (tmp_path / "f/status=validated").is_dir()
    sinks.coverage_report(spark.createDataFrame([("p", None), ("p", "calls"), ("p", "calls")], "prog string, reason string"), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).first()[0] == "(p 1 3 ((calls 2)))"
    sinks.cluster_report(df, str(tmp_path / "k"), "cluster", "validated")
    sinks.tab_report(df.select("cluster"), str(tmp_path / "t"))
