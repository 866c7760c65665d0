"""Analytics on a fetch log ``(url, attempt, status, ts)``; a NULL status is a
network error. All are aggregates with map-side reduction: a URL with very many
attempts is no hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import fixed
from linkloom.functions.urls import is_absolute_url
from linkloom.operators.skew import salted_join


def _alive(status: Column) -> Column:
    return F.coalesce(status.between(200, 399), F.lit(False))


def _terminal(status: Column) -> Column:
    return _alive(status) | F.coalesce(status.isin(*fixed.DEAD_STATUSES), F.lit(False))


def _wait(status: Column) -> Column:
    return (
        F.when(status.isNull(), fixed.WAIT_NETWORK_ERROR)
        .when(status == 429, fixed.WAIT_RATE_LIMITED)
        .when(status >= 500, fixed.WAIT_SERVER_ERROR)
        .otherwise(fixed.WAIT_OTHER_STATUS)
    )


def alive_strict(log: DataFrame) -> DataFrame:
    """Alive where the first attempt gave exactly 200: ``(url, alive)``."""
    first = F.min_by(F.coalesce(F.col("status") == 200, F.lit(False)), F.col("attempt"))
    return log.groupBy("url").agg(first.alias("alive"))


def alive_tolerant(log: DataFrame, attempts: int = fixed.DEFAULT_ATTEMPTS) -> DataFrame:
    """Alive by the first terminal answer among the first ``attempts``: ``(url, alive)``."""
    status, attempt = F.col("status"), F.col("attempt")
    counted = (attempt <= attempts) & _terminal(status)
    verdict = F.min_by(F.when(counted, _alive(status)), F.when(counted, attempt))
    return log.groupBy("url").agg(F.coalesce(verdict, F.lit(False)).alias("alive"))


def retry_backoff(log: DataFrame, attempts: int = fixed.DEFAULT_ATTEMPTS) -> DataFrame:
    """Seconds waited between attempts before the decision: ``(url, waited)``.

    One aggregate slot per attempt number: one shuffle, no join back.
    """
    status, attempt = F.col("status"), F.col("attempt")
    slots = []
    for i in range(1, attempts + 1):
        slots.append(F.max(F.when(attempt == i, F.when(_terminal(status), 0).otherwise(_wait(status)))).alias(f"_w{i}"))
    decided, waited = F.lit(False), F.lit(0).cast("bigint")
    # a terminal answer waits 0 seconds and ends the count
    for i in range(1, attempts + 1):
        slot = F.col(f"_w{i}")
        waited = waited + F.when(decided | slot.isNull(), 0).otherwise(slot)
        decided = decided | F.coalesce(slot == 0, F.lit(False))
    return log.groupBy("url").agg(*slots).select("url", waited.alias("waited"))


def seed_status(
    seeds: DataFrame, log: DataFrame, attempts: int = fixed.DEFAULT_ATTEMPTS,
    alive: str = "CRAWLED", dead: str = "URL UNREACHABLE",
) -> DataFrame:
    """What became of each seed: ``(seed, status)``. A seed without a log row
    counts as unreachable."""
    verdicts = alive_tolerant(log, attempts).withColumnRenamed("url", "seed")
    label = (
        F.when(~is_absolute_url(F.col("seed")), "INVALID URL")
        .when(F.coalesce(F.col("alive"), F.lit(False)), alive)
        .otherwise(dead)
    )
    return seeds.select("seed").distinct().join(verdicts, "seed", "left").select("seed", label.alias("status"))


def within_budget(results: DataFrame, seconds: int, seed: str = "seed", ts: str = "ts") -> DataFrame:
    """Rows a seed produced within ``seconds`` of its first; -1 is no limit.

    The start of each seed is a map-side reduced aggregate joined back on the
    seed, so a seed with a third of all rows is split over tasks instead of being
    one window partition.
    """
    if seconds < 0:
        return results
    starts = results.groupBy(seed).agg(F.min(ts).alias("_start"))
    in_time = F.col(ts) <= F.col("_start") + F.make_dt_interval(secs=F.lit(seconds))
    return salted_join(results, starts, seed).where(in_time).drop("_start")
