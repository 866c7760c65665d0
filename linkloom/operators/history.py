"""Crawl history ``(url, source, ts)``: append and merge, first one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import main_domain

COLUMNS = ("url", "source", "ts")


def new_entries(seeds: DataFrame, ts: Column | None = None) -> DataFrame:
    """History rows for the seeds of this run; the source is never filled in."""
    return seeds.select(
        F.col("seed").alias("url"),
        F.lit(None).cast("string").alias("source"),
        (F.current_timestamp() if ts is None else ts).alias("ts"),
    )


def missing_entries(history: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that an insert-or-ignore would add."""
    first = new.groupBy("url").agg(F.min(F.struct("ts", "source")).alias("_row"))
    return (
        first.join(history.select("url").distinct(), "url", "left_anti")
        .select("url", "_row.source", "_row.ts")
    )


def insert_or_ignore(history: DataFrame, new: DataFrame) -> DataFrame:
    """History with the rows of ``new`` whose URL it does not have."""
    return history.select(*COLUMNS).unionByName(missing_entries(history, new))


def merge_histories(histories: DataFrame, main: str) -> DataFrame:
    """One history from many ``(db_name, url, source, ts)``: rows of ``main`` win,
    then those of the first name in order.

    An aggregate, not a window: a URL that all runs have seen is reduced
    map-side instead of being sorted in one task.
    """
    rank = F.struct((F.col("db_name") != main).alias("late"), "db_name", "ts")
    return (
        histories.groupBy("url")
        .agg(F.min_by(F.struct("db_name", "source", "ts"), rank).alias("_row"))
        .select("url", "_row.db_name", "_row.source", "_row.ts")
    )


def with_domain_name(history: DataFrame) -> DataFrame:
    """History keyed for storage by the last two host labels."""
    return history.withColumn("db_name", F.coalesce(main_domain(F.col("url")), F.lit("unknown")))
