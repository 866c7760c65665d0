"""Tables and text files in."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import domain_of_host, host_of, is_absolute_url
from linkloom.operators.skew import salted_join

PAGE_SCHEMA = "page_id bigint, url string, html string"
HISTORY_SCHEMA = "url string, source string, ts timestamp"

# A host: labels of letters, digits, hyphens and underscores, the last of letters
# (or an internationalised one).
_HOST = r"(?i)^(?:[a-z0-9_](?:[a-z0-9_-]*[a-z0-9_])?\.)+(?:[a-z]{2,}|xn--[a-z0-9-]+)$"


def read_lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row per line, only the line end removed."""
    return spark.read.text(path).withColumnRenamed("value", column)


def valid_seeds(lines: DataFrame) -> DataFrame:
    """Lines that are absolute URLs: ``(seed, host)``."""
    return lines.where(is_absolute_url(F.col("seed"))).select("seed", host_of(F.col("seed")).alias("host"))


def invalid_seeds(lines: DataFrame) -> DataFrame:
    """The lines ``valid_seeds`` leaves out."""
    return lines.where(~is_absolute_url(F.col("seed"))).select("seed")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed list from a file or a directory of files: ``(seed, host)``."""
    return valid_seeds(read_lines(spark, path, "seed"))


def rejected_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a seed list that are no absolute URLs."""
    return invalid_seeds(read_lines(spark, path, "seed"))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Keyword list, one per line, blanks kept; an empty line is a keyword too."""
    return read_lines(spark, path, "keyword")


def read_filtered(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """Lines that ``write_filtered`` wrote: those with a keyword, or all of them."""
    rows = spark.read.schema("line string, matched boolean").text(path)
    return (rows if full else rows.where("matched")).select("line")


#: Rows of a spread table that go to one task, so that a task's memory does not grow with the table.
SPREAD_ROWS = 10_000


def spread(df: DataFrame) -> DataFrame:
    """Even out a table that comes in far fewer splits than there are cores, or
    than its rows ask for, as one unsplittable file does. A table large enough to fill the
    cluster is left alone: it needs no shuffle. For scans; a plan with a shuffle in it would be
    run to find out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, math.ceil(df.count() / SPREAD_ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() * 4 <= tasks else df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages; other columns than ``url`` and ``html`` are kept."""
    return spread(spark.read.parquet(path))


def parse_hosts(lines: DataFrame) -> DataFrame:
    """Bare hosts: ``(host, domain2, well_formed)``.

    A row is not well formed if it is no host name, or two run together: it ends
    in another host of the list with no dot before, and what comes before is a
    host name under a top-level label the list has. That is looked up with
    equi-joins on the suffixes of each row.
    """
    host = F.col("host")
    distinct = lines.select("host").distinct()
    suffixes = distinct.select(
        "host",
        F.explode_outer(
            F.filter(
                F.sequence(F.lit(2), F.greatest(F.length("host"), F.lit(2))),
                lambda at: F.substring(F.col("host"), at - 1, F.lit(1)) != ".",
            )
        ).alias("_at"),
    ).where(F.col("_at").isNotNull())
    suffixes = suffixes.select(
        "host",
        F.substr("host", F.col("_at")).alias("_second"),
        F.substring(host, F.lit(1), F.col("_at") - 1).alias("_first"),
    ).where(F.col("_first").rlike(_HOST))
    known = distinct.where(host.rlike(_HOST))
    tops = known.select(F.substring_index("host", ".", -1).alias("_top")).distinct()
    together = (
        suffixes.join(known.select(F.col("host").alias("_second")), "_second", "left_semi")
        .withColumn("_top", F.substring_index("_first", ".", -1))
        .join(tops, "_top", "left_semi")
        .select("host").distinct()
        .withColumn("_together", F.lit(True))
    )
    return salted_join(lines, together, "host", "left").select(
        "host",
        domain_of_host(host).alias("domain2"),
        (host.rlike(_HOST) & F.col("_together").isNull()).alias("well_formed"),
    )


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """Host list from text."""
    return parse_hosts(read_lines(spark, path, "host"))


def read_history(spark: SparkSession, path: str, schema: str = HISTORY_SCHEMA) -> DataFrame:
    """Crawl history; empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
