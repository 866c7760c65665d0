"""A crawl history laid out by hash of its URL.

The rows of a URL are in the bucket that its hash names, and each bucket in files of its own. An
append reshuffles what is new into as many parts as there are buckets and meets each with its
bucket: what is stored, however large it has become, is read in place and never shuffled. The
number of buckets is fixed when a history begins, as it is a part of its layout, and
is written into the folder's name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Enough for several hundred million URLs; more for a larger history.
BUCKETS = 64


def _table(spark: SparkSession, path: str, buckets: int) -> str:
    """Name of the table over the buckets; the catalog of each session learns it again."""
    folder = f"{path.rstrip('/')}/buckets-{buckets}"
    name = f"history_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"
    quoted = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (url STRING, source STRING, ts TIMESTAMP) USING parquet "
        f"CLUSTERED BY (url) INTO {buckets} BUCKETS LOCATION '{quoted}'"
    )
    return name


def bucketed_history(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The history ``(url, source, ts)`` at ``path``; empty if there is none yet."""
    return spark.table(_table(spark, path, buckets))


def missing_from(history: DataFrame, new: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``new`` whose URL the history does not have, the first of each URL."""
    first = new.groupBy("url").agg(F.min(F.struct("ts", "source")).alias("_row"))
    # Dealt like the buckets, or the planner may shuffle both sides into more parts. An outer
    # join, as an anti-join would be moved below the repartitioning.
    first = first.repartition(buckets, "url")
    known = history.select(F.col("url").alias("_known"))
    missing = first.join(known, F.col("url") == F.col("_known"), "left").where(F.col("_known").isNull())
    return missing.select("url", "_row.source", "_row.ts")


def append_bucketed(spark: SparkSession, new: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Add to the history at ``path`` the rows of ``new`` it does not have.

    ``new`` may not read that history: a job cannot read what it writes.
    """
    name = _table(spark, path, buckets)
    missing_from(spark.table(name), new, buckets).write.mode("append").insertInto(name)
    spark.catalog.refreshTable(name)
