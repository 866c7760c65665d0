"""Bounded walks over a captured corpus."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom import fixed
from linkloom.functions.urls import fetch_key, host_of, in_fetch_form
from linkloom.operators import history as hist
from linkloom.operators.extract import extract_links
from linkloom.operators.filters import in_scope_host, in_scope_subdomains, inside_path, keyword_predicate
from linkloom.operators.lookups import unprocessed_seeds
from linkloom.operators.skew import salted_join
from linkloom.session import cut_lineage


#: Seeds of one set; each is a bit of a long.
SET_SEEDS = 64
# Seeds of one host that are numbered together.
_NUMBERED = 1 << 16


@dataclass(frozen=True)
class CrawlResult:
    """``visited`` is ``(seed, url, depth)``; ``links`` is ``(seed, source, url, where_url, depth)``.

    ``reached`` is ``visited`` with a row per set of seeds: ``(seeds, bits, url, key, depth)``."""

    visited: DataFrame
    links: DataFrame
    reached: DataFrame


def _scope(subdomains: bool, inside: bool, extra_hosts: Sequence[str]) -> Column:
    url, seed_host = F.col("url"), F.col("seeds.host")
    scope = (
        in_scope_subdomains(url, seed_host)
        if subdomains
        else in_scope_host(url, seed_host, *[F.lit(h) for h in extra_hosts])
    )
    return scope & inside_path(url, F.col("seeds.path")) if inside else scope


def crawl(
    pages: DataFrame,
    seeds: DataFrame,
    depth: int = fixed.DEFAULT_DEPTH,
    *,
    profile: str = "full",
    subdomains: bool = False,
    inside: bool = False,
    extra_hosts: Sequence[str] = (),
    keywords: Sequence[str] | None = None,
    **options,
) -> CrawlResult:
    """Walk from each seed along ``a[href]`` to ``depth``; the seed page is depth 1.

    A page is parsed at the level that reaches it first, once for all seeds and levels, and no
    page is that no walk reaches: each level is joined with the page table before the
    tokenizer. What the loop joins is narrow: keys of captured pages, levels, and edges.
    All of these are written to the shared folder, so a lost executor never repeats the
    parsing. All walks run in the same jobs: seeds that share a scope are sets of up to
    ``SET_SEEDS``, a level has one row per set and page, and the bits of the seeds that are
    there. They are or-ed along edges; which are new is one aggregate. Seeds come apart
    in the result only.
    """
    held = _held(pages, seeds, extra_hosts, everywhere=subdomains)
    # of captures of one page the first answers
    captured = cut_lineage(held.groupBy("key").agg(F.min("url").alias("page")))
    one_host = not subdomains and not extra_hosts
    level, members = _seed_sets(_first_level(seeds, captured, held), inside)
    reached, fetched, parsed, edges = level, [], [], []
    for step in range(1, depth + 1):
        new = level.select("url").distinct()
        new = cut_lineage(new.join(_union(fetched), "url", "left_anti") if fetched else new)
        if not new.isEmpty():
            fetched.append(new)
            parsed.append(_parse(pages.join(new, "url", "left_semi"), profile, options))
            if step < depth:
                edges.append(_edges(parsed[-1], captured, one_host))
        if step == depth or not edges:
            break
        level = _next_level(level, reached, _union(edges), _scope(subdomains, inside, extra_hosts), step + 1)
        reached = reached.unionByName(level)

    lined = _union(parsed) if parsed else _parse(pages.where(F.lit(False)), profile, options)
    if keywords:
        lined = lined.where(keyword_predicate(F.col("raw"), keywords))
    # rows differ by raw form and by rule, which the result does not show; a link is inside only if each of them is.
    # Pages meet rows per seed last, so a result row is made once and never shuffled.
    lined = lined.groupBy("where_url", "source", "url").agg(F.bool_and("inside").alias("inside"))
    walked = _apart(reached, members).select("seed", "seeds.path", F.col("url").alias("where_url"), "depth")
    found = walked.join(lined, "where_url")
    if inside:
        found = found.where(~F.col("inside") | inside_path(F.col("url"), F.col("path")))
    return CrawlResult(
        _apart(reached, members).select("seed", "url", "depth"),
        found.select("seed", "source", "url", "where_url", "depth"),
        reached,
    )


def _seed_sets(first: DataFrame, inside: bool) -> tuple[DataFrame, DataFrame]:
    """The first level by sets of seeds ``(seeds, bits, url, key, depth)``, and ``(seeds, members)``, both written.

    Seeds of one host are numbered in parts of about ``_NUMBERED``, so a host with a third of
    all seeds is no one task's work. With ``inside`` the scope is the seed's own, and so is the set.
    """
    if inside:
        numbered = first.withColumn("path", F.col("seed")).withColumn("at", F.lit(0).cast("long")).withColumn("group", F.lit(0).cast("long"))
    else:
        sizes = first.groupBy("seed_host").agg(F.count("*").alias("n"))
        group = F.pmod(F.xxhash64("seed"), F.ceil(F.col("n") / _NUMBERED))
        order = Window.partitionBy("seed_host", "group").orderBy("seed")
        numbered = (
            salted_join(first, sizes, "seed_host").withColumn("group", group)
            .withColumn("at", (F.row_number().over(order) - 1).cast("long")).withColumn("path", F.lit(""))
        )
    block = F.floor(F.col("at") / SET_SEEDS).cast("long")
    numbered = cut_lineage(
        numbered.select(
            F.struct(F.col("seed_host").alias("host"), "path", "group", block.alias("block")).alias("seeds"),
            F.pmod("at", F.lit(SET_SEEDS)).cast("int").alias("bit"), "seed", "url", "key", "depth",
        )
    )
    level = numbered.groupBy("seeds", "url", "key", "depth").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    # at most SET_SEEDS members each
    members = numbered.groupBy("seeds").agg(F.sort_array(F.collect_list(F.struct("bit", "seed")))["seed"].alias("members"))
    return cut_lineage(level), cut_lineage(members)


def _next_level(level: DataFrame, reached: DataFrame, edges: DataFrame, scope: Column, depth: int) -> DataFrame:
    """Pages one edge on, with the seeds that were not there before, written."""
    none = F.lit(0).cast("long")
    arriving = (
        level.select("seeds", "bits", F.col("url").alias("where_url")).join(edges, "where_url").where(scope)
        .select("seeds", "key", "url", "bits", none.alias("before"))
    )
    earlier = reached.select("seeds", "key", F.lit(None).cast("string").alias("url"), none.alias("bits"), F.col("bits").alias("before"))
    # a key has one page, so any of its rows names it
    met = arriving.unionByName(earlier).groupBy("seeds", "key").agg(
        F.max("url").alias("url"), F.bit_or("bits").bitwiseAND(F.bitwise_not(F.bit_or("before"))).alias("bits")
    )
    return cut_lineage(met.where("bits != 0").withColumn("depth", F.lit(depth)))


def _apart(rows: DataFrame, members: DataFrame) -> DataFrame:
    """A row per seed of each row's set."""
    there = F.filter("members", lambda _, at: F.getbit("bits", at) == 1)
    return salted_join(rows, members, "seeds").withColumn("seed", F.explode(there))


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _held(pages: DataFrame, seeds: DataFrame, extra_hosts: Sequence[str], everywhere: bool) -> DataFrame:
    """``(url, key)`` of the pages, written; the key is what a fetch would ask for.

    Links and pages meet on the key, so a fragment, dot segments or a bare host do not hide a
    page. Unless ``everywhere``, hosts no walk can be on are left out.
    """
    urls = pages.select("url", fetch_key(F.col("url")).alias("key"))
    if not everywhere:
        named = F.array(*[F.lit(h.lower()) for h in extra_hosts]).cast("array<string>")
        hosts = seeds.select(F.explode(F.array_append(named, F.lower(host_of(F.col("seed"))))).alias("_reach"))
        hosts = cut_lineage(hosts.where("_reach is not null").distinct())
        urls = urls.join(hosts, F.lower(_host(F.col("key"))) == F.col("_reach"), "left_semi")
    return cut_lineage(urls)


def _first_level(seeds: DataFrame, captured: DataFrame, held: DataFrame) -> DataFrame:
    """``(seed, seed_host, url, key, depth)`` of the seeds that were captured, written."""
    return cut_lineage(
        seeds.select("seed").distinct()
        .withColumn("seed_host", host_of(F.col("seed")))
        .where(F.col("seed_host").isNotNull())
        .withColumn("key", fetch_key(F.col("seed")))
        .join(captured, "key")
        # a seed captured as written is its own page
        .join(held.select(F.col("url").alias("own")).distinct(), F.col("seed") == F.col("own"), "left")
        .select("seed", "seed_host", F.coalesce("own", "page").alias("url"), "key", F.lit(1).alias("depth"))
    )


def _parse(pages: DataFrame, profile: str, options: dict) -> DataFrame:
    """Links of the pages, with the host of each page, written."""
    options = {**options, "keep": [*options.get("keep", ()), "_host"]}
    hosted = pages.select("url", "html", F.lower(_host(fetch_key(F.col("url")))).alias("_host"))
    return cut_lineage(extract_links(hosted, profile, lineage=True, **options))


def _host(key: Column) -> Column:
    """Host of a fetch key."""
    return F.when(in_fetch_form(key), F.substring_index(F.substring_index(key, "/", 3), "/", -1)).otherwise(host_of(key))


def _edges(lined: DataFrame, captured: DataFrame, one_host: bool) -> DataFrame:
    """``(where_url, url, key)`` of followed links to captured pages, written."""
    edges = lined.where("follow").select("where_url", "_host", fetch_key(F.col("url")).alias("key"))
    if one_host:
        # a walk stays on one host, so edges between hosts can go before any shuffle
        edges = edges.where(_host(F.col("key")) == F.col("_host"))
    edges = edges.select("where_url", "key").distinct()
    return cut_lineage(edges.join(captured, "key").select("where_url", F.col("page").alias("url"), "key"))


def resume(
    pages: DataFrame, seeds: DataFrame, history: DataFrame, depth: int = fixed.DEFAULT_DEPTH,
    *, ts: Column | None = None, **options,
) -> tuple[CrawlResult, DataFrame]:
    """Crawl the seeds the history does not have; the result and the new history.

    A seed is recorded whether or not its page was captured.
    """
    todo = cut_lineage(unprocessed_seeds(seeds, history))
    result = crawl(pages, todo, depth, **options)
    return result, hist.insert_or_ignore(history, hist.new_entries(todo, ts))
