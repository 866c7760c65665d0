"""Streams give what the batch jobs give, across restarts too."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from linkloom.operators.extract import extract_links
from linkloom.operators.dedupe import ScalableSpec
from linkloom.sources.sinks import with_line
from linkloom.streaming import links as S

SCHEMA = "url string, html string"


def put(spark, path, *rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))

    def run():
        lines = with_line(S.stream_links(S.stream_pages(spark, source, SCHEMA), "core")).select("line")
        S.start_parquet(S.stream_unique(lines, ["line"]), out, marks).awaitTermination()

    put(spark, source, ("http://h/1", "<a href=/x><a href=/y>"), ("http://h/2", "<a href=/x>"))
    run()
    put(spark, source, ("http://h/3", "<a href=/y><a href=/z>"))
    run()
    got = sorted(r[0] for r in spark.read.parquet(out).collect())
    batch = with_line(extract_links(spark.read.parquet(source), "core")).select("line").distinct()
    assert got == sorted(r[0] for r in batch.collect()) == ["http://h/x", "http://h/y", "http://h/z"]


def test_unique_within_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, source, ("u", "a"), ("u", "a"), ("v", "a"))
    rows = S.stream_pages(spark, source, SCHEMA).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    unique = S.stream_unique(rows, ["url"], event_time="ts")
    S.start_parquet(unique, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_history_across_batches_and_restarts(spark, tmp_path):
    source, out, history, marks = (str(tmp_path / n) for n in ("in", "out", "history", "marks"))

    def run(*seeds):
        spark.createDataFrame([(s,) for s in seeds], "seed string").coalesce(1).write.mode("append").parquet(source)
        stream = S.stream_pages(spark, source, "seed string", max_files=1)
        S.start_history(stream, history, out, marks).awaitTermination()
        return sorted(r["seed"] for r in spark.read.parquet(out).collect())

    assert run("a", "b", "a") == ["a", "b"]
    assert run("b", "c") == ["a", "b", "c"]
    assert run("a") == ["a", "b", "c"]


def test_history_batches_read_nothing_of_earlier_ones(spark, tmp_path):
    source, out, history, marks = (str(tmp_path / n) for n in ("in", "out", "history", "marks"))
    earlier = spark.createDataFrame([("old", None, dt.datetime(2024, 1, 1))], "url string, source string, ts timestamp")
    seen = set()
    for k in range(4):
        seeds = ["old", "every", f"own{k}"]
        spark.createDataFrame([(s,) for s in seeds], "seed string").coalesce(1).write.mode("append").parquet(source)
        # each start records elsewhere, so what earlier batches wrote is out of sight; the state alone tells
        S.start_history(S.stream_pages(spark, source, "seed string", max_files=1), f"{history}{k}", out, marks, earlier).awaitTermination()
        seen |= {"every", f"own{k}"}
        assert sorted(r["seed"] for r in spark.read.parquet(out).select("seed").collect()) == sorted(seen)


def test_bloom_unique_across_batches_and_restarts(spark, tmp_path):
    source, out, filters, marks = (str(tmp_path / n) for n in ("in", "out", "filters", "marks"))
    spec = ScalableSpec(capacity=50, error_rate=1e-9)

    def run(*lines):
        spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("append").parquet(source)
        stream = S.stream_pages(spark, source, "line string", max_files=1)
        S.start_bloom_unique(stream, filters, out, marks, spec).awaitTermination()
        return sorted(r["line"] for r in spark.read.parquet(out).collect())

    assert run("a", "b", "a", None) == ["a", "b"]
    assert run("b", "c", *[f"x{i}" for i in range(300)]) == sorted(["a", "b", "c", *[f"x{i}" for i in range(300)]])
    assert run("a", "x7") == run("c") and len(list(Path(filters).glob("version-*"))) == 2
    assert spark.read.parquet(f"{filters}/version-3").select("slice").distinct().count() > 1


def test_arriving_pages_come_in_few_files(spark):
    from linkloom.plans.catalog import _page_source

    pages = spark.range(400).selectExpr("concat('http://h/', id) AS url", "'<p>' AS html").repartition(60)
    arrived = spark.read.parquet(_page_source(spark, pages))
    assert len(arrived.inputFiles()) == 6
    assert sorted(r.url for r in arrived.collect()) == sorted(r.url for r in pages.collect())


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _store(spark, tmp_path, name) -> str:
    source, out, marks = (str(tmp_path / name / x) for x in ("in", "out", "marks"))
    spark.createDataFrame([("a",), ("b",), ("a",)], "line string").write.parquet(source)
    S.start_parquet(S.stream_unique(S.stream_pages(spark, source, "line string"), ["line"]), out, marks).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["a", "b"]
    return (tmp_path / name / "marks" / "offsets" / "0").read_text()


def test_state_is_on_disk_unless_the_session_names_a_store(spark, tmp_path):
    named = spark.conf.get(PROVIDER)
    try:
        spark.conf.unset(PROVIDER)
        before = dict(spark.conf.getAll)
        assert "RocksDBStateStoreProvider" in _store(spark, tmp_path, "default")
        assert dict(spark.conf.getAll) == before
        spark.conf.set(PROVIDER, named.replace("RocksDBStateStoreProvider", "HDFSBackedStateStoreProvider"))
        assert "HDFSBackedStateStoreProvider" in _store(spark, tmp_path, "named")
    finally:
        spark.conf.set(PROVIDER, named)
