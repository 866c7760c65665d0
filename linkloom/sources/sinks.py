"""Results out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.render import render_json, render_line
from linkloom.functions.urls import seed_domain
from linkloom.operators import history as hist
from linkloom.operators.filters import keyword_filter, keyword_predicate


def with_line(links: DataFrame, show_source: bool = False, show_where: bool = False) -> DataFrame:
    """Links with their rendered ``line``."""
    return links.withColumn(
        "line", render_line(F.col("url"), F.col("source"), F.col("where_url"), show_source, show_where)
    )


def with_json(links: DataFrame, show_where: bool = False) -> DataFrame:
    """Links with their JSON ``line``."""
    return links.withColumn("line", render_json(F.col("url"), F.col("source"), F.col("where_url"), show_where))


def write_lines(lines: DataFrame, path: str, mode: str = "append", keywords: Sequence[str] | None = None) -> None:
    """Lines as text. The file has its own keyword test, on the line as rendered."""
    kept = keyword_filter(lines, keywords, "line") if keywords else lines
    kept.select("line").write.mode(mode).text(path)


def write_json_lines(links: DataFrame, path: str, mode: str = "append", show_where: bool = False) -> None:
    """One JSON object per line."""
    with_json(links, show_where).select("line").write.mode(mode).text(path)


def write_by_depth(links: DataFrame, path: str, mode: str = "append") -> None:
    """Text files in a directory per seed domain and depth.

    Repartitioning by both columns and a spread of the lines bounds the number
    of files, and lets a large domain be written by many tasks.
    """
    domain = F.translate(seed_domain(F.col("where_url")), ":", "_")
    rows = links.select(F.col("url").alias("line"), domain.alias("domain"), "depth")
    # rebalance splits partitions that are too large and joins small ones
    rows.hint("rebalance", "domain", "depth").write.mode(mode).partitionBy("domain", "depth").text(path)


def write_filtered(
    lines: DataFrame, keywords: Sequence[str], path: str, keep_full: bool = True, mode: str = "overwrite"
) -> None:
    """The lines that contain a keyword, and the others beside them if wanted.

    One write, with the test as a partition: ``matched=true`` and ``matched=false`` below ``path``, so
    what makes the lines runs once. ``readers.read_filtered`` gives either set.
    """
    matched = F.coalesce(keyword_predicate(F.col("line"), keywords), F.lit(False))
    rows = lines.select("line", matched.alias("matched"))
    (rows if keep_full else rows.where("matched")).write.mode(mode).partitionBy("matched").text(path)


def append_history(history: DataFrame, new: DataFrame, path: str) -> None:
    """Add to the history at ``path`` the rows of ``new`` it does not have."""
    hist.missing_entries(history, new).write.mode("append").parquet(path)


def write_histories(histories: DataFrame, path: str, mode: str = "append") -> None:
    """Histories of several runs, one directory per ``db_name``."""
    histories.write.mode(mode).partitionBy("db_name").parquet(path)
