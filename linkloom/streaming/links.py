"""The same jobs on streams of pages, lines and seeds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators import history as hist
from linkloom.operators.dedupe import SCALABLE_SCHEMA, ScalableSpec, scalable_add, scalable_unique, unique_lines
from linkloom.operators.extract import extract_links
from linkloom.session import RECOMMENDED
from linkloom.sources.readers import HISTORY_SCHEMA, PAGE_SCHEMA

_STORE = "spark.sql.streaming.stateStore"
#: Keyed state on local disk, in memory that does not grow with it. A batch writes what it adds; the store that is
#: Spark's default holds all keys on the heap and copies their map for every batch.
STATE_STORE = {
    f"{_STORE}.providerClass": RECOMMENDED[f"{_STORE}.providerClass"],
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "false",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """While a query starts, ``STATE_STORE`` holds for it, unless the session names a store. A query
    keeps the settings it starts with, and one that goes on after a stop has the store it began with."""
    named = spark.conf.getAll
    own = {} if f"{_STORE}.providerClass" in named else {k: v for k, v in STATE_STORE.items() if k not in named}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in own:
            spark.conf.unset(key)


def stream_pages(spark: SparkSession, path: str, schema: str = PAGE_SCHEMA, max_files: int | None = None) -> DataFrame:
    """Pages as they arrive in ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_links(pages: DataFrame, profile: str = "full", **options) -> DataFrame:
    """Links of each page at once. No state: repeats within a page stay unless
    ``stream_unique`` follows."""
    return extract_links(pages, profile, distinct=False, **options)


def stream_unique(rows: DataFrame, columns: list[str], event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each row once over the life of the stream.

    The state has one entry per distinct row and grows without bound, on disk (``STATE_STORE``). With
    ``event_time`` repeats are looked for within ``delay`` only, and state is
    dropped after it.
    """
    if event_time is None:
        return rows.dropDuplicates(columns)
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(columns)


def start_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there now, then stop; run again to go on."""
    with _state_store(rows.sparkSession):
        return (
            rows.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )


def start_history(
    seeds: DataFrame, history_path: str, new_path: str, checkpoint: str, earlier: DataFrame | None = None
) -> StreamingQuery:
    """Pass on seeds never seen before, in this run or an earlier one.

    Which seeds the stream has had is keyed state (``STATE_STORE``), kept in the
    checkpoint across batches and restarts, so a batch reads nothing that batches before it
    wrote and costs the same however many there were. ``earlier`` is a history ``(url, source, ts)`` from
    before the stream's first start; it must not change. Each batch is recorded under its
    own number: one that runs again after a failure replaces what it wrote.
    """
    fresh = seeds.select("seed").where(F.col("seed").isNotNull())
    if earlier is not None:
        fresh = fresh.join(earlier.select(F.col("url").alias("seed")).distinct(), "seed", "left_anti")

    def each(batch: DataFrame, number: int) -> None:
        recorded = f"{history_path}/batch={number}"
        hist.new_entries(batch).write.mode("overwrite").parquet(recorded)
        rows = batch.sparkSession.read.schema(HISTORY_SCHEMA).parquet(recorded)
        rows.select(F.col("url").alias("seed")).write.mode("overwrite").parquet(f"{new_path}/batch={number}")

    with _state_store(fresh.sparkSession):
        return (
            fresh.dropDuplicates(["seed"]).writeStream.foreachBatch(each)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def start_bloom_unique(
    lines: DataFrame, filter_path: str, new_path: str, checkpoint: str, spec: ScalableSpec = ScalableSpec()
) -> StreamingQuery:
    """Lines that a growing Bloom filter has not seen, in this run or an earlier one.

    The approximate form of ``stream_unique``: the state is some ten bits a line in place of
    the line. A batch reads the filters as the batch before it left them, and writes its own version
    and its new lines under its number, so a batch that runs again starts from the same and
    replaces what it wrote. Only the last two versions are kept: the size of the state is that of the
    filters. A line taken for a repeat, at the error rate of ``spec``, is left out.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = [n for n in _versions(spark, filter_path) if n < number]
        earlier = spark.read.schema(SCALABLE_SCHEMA).parquet(_version(filter_path, max(held))) if held else None
        now = unique_lines(batch.select("line").where(F.col("line").isNotNull()))
        fresh = now if earlier is None else scalable_unique(now, earlier, spec)
        fresh.write.mode("overwrite").parquet(f"{new_path}/batch={number}")
        added = spark.read.schema("line string").parquet(f"{new_path}/batch={number}")
        scalable_add(added, earlier, spec).write.mode("overwrite").parquet(_version(filter_path, number))
        for old in sorted(held)[:-1]:
            _delete(spark, _version(filter_path, old))

    return (
        lines.select("line").writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _version(path: str, number: int) -> str:
    return f"{path}/version-{number}"


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions in a folder."""
    files, folder = _file_system(spark, path)
    if not files.exists(folder):
        return []
    found = [s.getPath() for s in files.listStatus(folder)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [int(p.getName().removeprefix("version-")) for p in found if p.getName().startswith("version-") and files.exists(done(p, "_SUCCESS"))]


def _delete(spark: SparkSession, path: str) -> None:
    files, folder = _file_system(spark, path)
    files.delete(folder, True)
