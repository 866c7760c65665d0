"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import render, text as T, urls as U
from linkloom.operators import crawl as C
from linkloom.operators import dedupe as D
from linkloom.operators import extract as E
from linkloom.operators import fetchlog as L
from linkloom.operators import filters as FL
from linkloom.operators import history as H
from linkloom.operators import lookups as K
from linkloom.operators import rules as R
from linkloom.operators.elements import html_elements
from linkloom.plans import corpora as P
from linkloom.session import scratch_path
from linkloom.sources import buckets, readers, sinks
from linkloom.streaming import links as S

Query = Callable[[SparkSession, str], DataFrame]

# Labels that have a query of their own, with the query names.
LABELS = {
    "href": "href", "script": "script", "form": "form", "jscode": "jscode", "css": "css",
    "embedded": "embedded", "interactive": "interactive", "custom_REGEX": "custom_REGEX", "src": "src",
    "data": "data", "meta": "meta", "custom-data": "custom_data", "video": "video", "audio": "audio",
    "embed": "embed", "track": "track", "area": "area", "applet": "applet", "base": "base",
    "bgsound": "bgsound", "body-background": "body_background", "feed": "feed", "webp-image": "webp_image",
    "manifest": "manifest", "social-media": "social_media", "sitemap": "sitemap", "data-uri": "data_uri",
    "websocket": "websocket", "frame": "frame",
}
KEYWORDS = ["api", ".json", "sub/", "https://cdn.example.net"]
LINE_KEYWORDS = ["css", "[form]", "p/1"]
#: A small first slice, so that the series grows on the test tables too.
BLOOM = D.ScalableSpec(capacity=100)
HISTORY_BUCKETS = 8
START = "1995-01-01 00:00:00"
BUDGET_SECONDS = 86400


def _link_query(label: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.link_label(P.captured_pages(spark, sf_dir), label, **options)

    return query


def _extract_query(profile: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.extract_links(P.captured_pages(spark, sf_dir), profile)

    return query


def _plain_query(rule: R.LinkRule) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.links_by_rules(
            P.captured_pages(spark, sf_dir), (rule,), honor_base=False, keep_fragment=True, distinct=False,
            raw_tags=E.fixed.RAW_TEXT_TAGS_PLAIN,
        )

    return query


def seeds_valid(spark, sf_dir):
    path = scratch_path(spark, "seeds")
    P.seed_lines(spark, sf_dir).write.text(path)
    return readers.read_seeds(spark, path)


def seeds_rejected(spark, sf_dir):
    path = scratch_path(spark, "seeds")
    P.seed_lines(spark, sf_dir).write.text(path)
    return readers.rejected_seeds(spark, path)


def hosts_parsed(spark, sf_dir):
    path = scratch_path(spark, "hosts")
    P.host_lines(spark, sf_dir).write.text(path)
    return readers.read_hosts(spark, path)


def _core_lines(spark, sf_dir) -> DataFrame:
    return sinks.with_line(E.extract_links(P.captured_pages(spark, sf_dir), "core"), True, True)


def sink_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    sinks.write_lines(_core_lines(spark, sf_dir), path)
    return readers.read_lines(spark, path, "line")


def sink_json(spark, sf_dir):
    path = scratch_path(spark, "json")
    sinks.write_json_lines(E.extract_links(P.captured_pages(spark, sf_dir), "core"), path, show_where=True)
    return readers.read_lines(spark, path, "line")


def sink_filtered(spark, sf_dir):
    path = scratch_path(spark, "filtered")
    sinks.write_filtered(_core_lines(spark, sf_dir), LINE_KEYWORDS, path, keep_full=False)
    return readers.read_filtered(spark, path, full=True)


def sink_both(spark, sf_dir):
    """The filtered lines and all lines, written at once."""
    path = scratch_path(spark, "both")
    sinks.write_filtered(_core_lines(spark, sf_dir), LINE_KEYWORDS, path)
    kinds = (("filtered", False), ("full", True))
    filtered, full = [readers.read_filtered(spark, path, full=f).withColumn("kind", F.lit(k)) for k, f in kinds]
    return filtered.unionByName(full)


def keywords_read(spark, sf_dir):
    """A keyword list as text: blanks stay, an empty line is a keyword too."""
    path = scratch_path(spark, "keywords")
    P.keyword_lines(spark, sf_dir).write.text(path)
    return readers.read_keywords(spark, path)


def pages_read(spark, sf_dir):
    """Captured pages from their table, with columns besides the body."""
    return readers.read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", F.octet_length("html").cast("bigint").alias("octets"))


def inside_path_full(spark, sf_dir):
    """Inside-path over the full set: it holds for followed anchors, not for other elements with an address."""
    links = E.extract_links(P.captured_pages(spark, sf_dir), "full", lineage=True)
    seed = F.concat(F.lit("https://"), U.host_of(F.col("where_url")), F.lit("/p/"))
    kept = links.where(~F.col("inside") | FL.inside_path(F.col("url"), seed))
    return kept.select("source", "url", "where_url", "inside").distinct()


def scope_host_extra(spark, sf_dir):
    """Links on the page's own host or on one more."""
    links = E.link_label(P.captured_pages(spark, sf_dir), "href")
    return links.where(FL.in_scope_host(F.col("url"), U.host_of(F.col("where_url")), F.lit("example.org")))


def link_anchor(spark, sf_dir):
    """Followed anchors alone, without other elements that have an address."""
    return E.links_by_rules(P.captured_pages(spark, sf_dir), (R.ANCHOR,))


def absolute_url_encoded(spark, sf_dir):
    """References resolved and percent-encoded."""
    found = U.absolute_url(F.col("link"), F.col("base"), encode="path")
    return P.references(spark, sf_dir).select("p_partkey", found.alias("url"))


def alive_two_attempts(spark, sf_dir):
    return L.alive_tolerant(P.fetch_log(spark, sf_dir), attempts=2)


def sink_by_depth(spark, sf_dir):
    path = scratch_path(spark, "depth")
    links = E.plain_links(P.captured_pages(spark, sf_dir), depths=1)
    sinks.write_by_depth(links, path)
    return spark.read.schema("value string, domain string, depth int").text(path).select(
        F.col("value").alias("line"), "domain", "depth"
    )


def host_of(spark, sf_dir):
    return P.url_table(spark, sf_dir).select("url", U.host_of(F.col("url")).alias("host"))


def main_domain(spark, sf_dir):
    return P.url_table(spark, sf_dir).select("url", U.main_domain(F.col("url")).alias("domain"))


def seed_domain(spark, sf_dir):
    return P.url_table(spark, sf_dir).select("url", U.seed_domain(F.col("url")).alias("domain"))


def absolute_url(spark, sf_dir):
    return P.references(spark, sf_dir).select(
        "p_partkey", U.absolute_url(F.col("link"), F.col("base")).alias("url")
    )


def absolute_url_base(spark, sf_dir):
    return E.links_by_rules(P.based_pages(spark, sf_dir), (R.ANCHOR, R.EMBEDDED))


def parse_headers(spark, sf_dir):
    lines = P.header_lines(spark, sf_dir)
    return lines.select("o_orderkey", F.explode_outer(render.parse_headers(F.col("raw"))).alias("name", "value"))


def truncate_body(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", T.truncate_body(F.col("text"), 1).alias("body"))


def render_line(spark, sf_dir):
    return _core_lines(spark, sf_dir).select("url", "line")


def render_json(spark, sf_dir):
    return sinks.with_json(E.extract_links(P.captured_pages(spark, sf_dir), "core")).select("url", "line")


def _text_query(find) -> Query:
    def query(spark, sf_dir):
        docs = P.linked_documents(spark, sf_dir)
        return docs.select("doc_id", F.explode_outer(find(F.col("text"))).alias("url")).where(F.col("url").isNotNull())

    return query


def is_textual(spark, sf_dir):
    return P.content_types(spark, sf_dir).select(
        "event_id", "content_type", U.is_textual(F.col("content_type")).alias("textual")
    )


def gate_textual(spark, sf_dir):
    return FL.gate_textual(P.content_types(spark, sf_dir))


def elements(spark, sf_dir):
    return html_elements(P.captured_pages(spark, sf_dir)).select(
        "url", F.col("ord").cast("bigint").alias("ord"), "tag", F.col("attrs")["href"].alias("href")
    )


def py_third_party(spark, sf_dir):
    return E.plain_unresolved(P.captured_pages(spark, sf_dir))


def py_links(spark, sf_dir):
    return E.plain_links(P.captured_pages(spark, sf_dir))


def py_depths(spark, sf_dir):
    links = E.plain_links(P.captured_pages(spark, sf_dir), depths=2)
    return links.withColumn("depth", F.col("depth").cast("bigint"))


def kw_filter(spark, sf_dir):
    return E.extract_links(P.captured_pages(spark, sf_dir), "full", keywords=KEYWORDS)


def kw_filter_line(spark, sf_dir):
    return FL.keyword_filter(_core_lines(spark, sf_dir), LINE_KEYWORDS, "line").select("line")


def inside_path(spark, sf_dir):
    links = E.extract_links(P.captured_pages(spark, sf_dir), "core", lineage=True)
    seed = F.concat(F.lit("https://"), U.host_of(F.col("where_url")), F.lit("/p/"))
    return links.where(~F.col("inside") | FL.inside_path(F.col("url"), seed)).select("source", "url", "where_url").distinct()


def scope_host(spark, sf_dir):
    links = E.link_label(P.captured_pages(spark, sf_dir), "href")
    return links.where(FL.in_scope_host(F.col("url"), U.host_of(F.col("where_url"))))


def scope_subs(spark, sf_dir):
    links = E.link_label(P.captured_pages(spark, sf_dir), "href")
    return links.where(FL.in_scope_subdomains(F.col("url"), F.lit("example.com")))


def scope_host_list(spark, sf_dir):
    return K.scope_host_list(P.customer_links(spark, sf_dir), P.supplier_hosts(spark, sf_dir))


def kw_matches(spark, sf_dir):
    urls = E.extract_links(P.captured_pages(spark, sf_dir), "core", distinct=False).select("url").distinct()
    return K.keyword_matches(urls, P.supplier_keywords(spark, sf_dir), "url")


def kw_filter_table(spark, sf_dir):
    links = E.extract_links(P.captured_pages(spark, sf_dir), "core", distinct=False)
    # repeats go after the filter, which leaves fewer rows to be shuffled
    return K.keyword_semi_join(links, P.supplier_keywords(spark, sf_dir), "url").distinct()


def _all_seeds(spark, sf_dir) -> DataFrame:
    return P.histories(spark, sf_dir).select(F.col("url").alias("seed"))


def _main_history(spark, sf_dir) -> DataFrame:
    return P.histories(spark, sf_dir).where(F.col("db_name") == P.MAIN_HISTORY).select("url", "source", "ts")


def seeds_unprocessed(spark, sf_dir):
    return K.unprocessed_seeds(_all_seeds(spark, sf_dir), _main_history(spark, sf_dir))


def history_append(spark, sf_dir):
    """Append to a stored history twice and read it back."""
    path = scratch_path(spark, "history")
    buckets.append_bucketed(spark, _main_history(spark, sf_dir), path, HISTORY_BUCKETS)
    buckets.append_bucketed(spark, P.histories(spark, sf_dir).select("url", "source", "ts"), path, HISTORY_BUCKETS)
    return buckets.bucketed_history(spark, path, HISTORY_BUCKETS).select("url", "ts")


def history_append_files(spark, sf_dir):
    """The same on a history of plain files."""
    path = scratch_path(spark, "history")
    _main_history(spark, sf_dir).write.parquet(path)
    later = P.histories(spark, sf_dir).select("url", "source", "ts")
    sinks.append_history(readers.read_history(spark, path), later, path)
    return readers.read_history(spark, path).select("url", "ts")


def history_merge(spark, sf_dir):
    return H.merge_histories(P.histories(spark, sf_dir), P.MAIN_HISTORY).select("db_name", "url", "ts")


def history_domains(spark, sf_dir):
    """Histories stored by domain and read back from their directories."""
    path = scratch_path(spark, "domains")
    rows = H.merge_histories(P.histories(spark, sf_dir), P.MAIN_HISTORY).select("url", "source", "ts")
    sinks.write_histories(H.with_domain_name(rows), path)
    return spark.read.schema(f"{readers.HISTORY_SCHEMA}, db_name string").parquet(path).select("url", "db_name")


def unique_lines(spark, sf_dir):
    links = E.extract_links(P.captured_pages(spark, sf_dir), "full", distinct=False)
    return D.unique_lines(sinks.with_line(links)).select("line")


def _history_lines(spark, sf_dir, *names: str) -> DataFrame:
    rows = P.histories(spark, sf_dir)
    rows = rows.where(F.col("db_name").isin(*names)) if names else rows
    return rows.select(F.col("url").alias("line")).distinct()


def bloom_seen(spark, sf_dir):
    filters = D.scalable_add(_history_lines(spark, sf_dir, "crawler-0"), spec=BLOOM)
    return D.scalable_test(_history_lines(spark, sf_dir), filters, BLOOM)


def bloom_persist(spark, sf_dir):
    """The filters of one run, stored, read by the next, extended, stored, and asked for what is new."""
    filters = None
    for name in ("crawler-1", "crawler-2"):
        path = scratch_path(spark, "bloom")
        D.scalable_add(_history_lines(spark, sf_dir, name), filters, BLOOM).write.parquet(path)
        filters = spark.read.parquet(path)
    return D.scalable_unique(_history_lines(spark, sf_dir), filters, BLOOM)


def _page_seeds(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("url").alias("seed"))


def crawl_visited(spark, sf_dir):
    pages = P.captured_pages(spark, sf_dir)
    result = C.crawl(pages, _page_seeds(pages), 4, profile="core")
    return result.visited.withColumn("depth", F.col("depth").cast("bigint"))


def crawl_depth(spark, sf_dir):
    pages = P.captured_pages(spark, sf_dir)
    result = C.crawl(pages, _page_seeds(pages), 2, profile="core")
    return result.links.withColumn("depth", F.col("depth").cast("bigint"))


def crawl_multi(spark, sf_dir):
    pages = P.captured_pages(spark, sf_dir)
    result = C.crawl(pages, _page_seeds(pages), 3, profile="core", subdomains=True)
    return D.unique_lines(sinks.with_line(result.links, show_source=True)).select("line")


def crawl_resume(spark, sf_dir):
    pages = P.captured_pages(spark, sf_dir)
    start = F.lit(START).cast("timestamp")
    done = P.table(spark, sf_dir, "part").where(F.col("p_size") <= 10).select(
        P.shop_url(F.col("p_partkey")).alias("url"), F.lit(None).cast("string").alias("source"), start.alias("ts")
    )
    result, history = C.resume(pages, _page_seeds(pages), done, 2, ts=start, profile="core")
    recorded = history.select(
        F.lit("history").alias("kind"), F.col("url").alias("seed"), "url", F.lit(0).cast("bigint").alias("depth")
    )
    walked = result.visited.select(F.lit("visited").alias("kind"), "seed", "url", F.col("depth").cast("bigint").alias("depth"))
    return recorded.unionByName(walked)


def alive_strict(spark, sf_dir):
    return L.alive_strict(P.fetch_log(spark, sf_dir))


def alive_tolerant(spark, sf_dir):
    return L.alive_tolerant(P.fetch_log(spark, sf_dir))


def retry_backoff(spark, sf_dir):
    return L.retry_backoff(P.fetch_log(spark, sf_dir))


def seed_status(spark, sf_dir):
    events = P.table(spark, sf_dir, "events")
    block = P.text(F.floor(F.col("event_id") / 8))
    seeds = events.select(
        F.when(F.col("event_type") == "error", F.concat(F.lit("u"), block, F.lit(".example.com")))
        .otherwise(F.concat(F.lit("https://u"), block, F.lit(".example.com/")))
        .alias("seed")
    )
    return L.seed_status(seeds, P.fetch_log(spark, sf_dir))


def within_budget(spark, sf_dir):
    return L.within_budget(P.budget_log(spark, sf_dir), BUDGET_SECONDS).select("seed", "event_id")


def _stream_source(spark, df: DataFrame) -> str:
    path = scratch_path(spark, "arrivals")
    df.write.parquet(path)
    return path


#: Spread tasks whose pages go to one arriving file, and the size of a row group there: two files fill the
#: cores of a cluster, as they are read in splits, and batches grow in number with the pages only.
FILE_TASKS, ROW_GROUP = 10, 4 << 20


def _page_source(spark, pages: DataFrame) -> str:
    """Pages as arriving files, of a bounded number of rows each; four of them at least, if there are tasks for it."""
    path = scratch_path(spark, "arrivals")
    files = max(4, -(-pages.rdd.getNumPartitions() // FILE_TASKS))
    pages.coalesce(files).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return path


def stream_extract(spark, sf_dir):
    source = _page_source(spark, P.captured_pages(spark, sf_dir))
    out = scratch_path(spark, "stream-links")
    pages = S.stream_pages(spark, source, "url string, html string", max_files=2)
    S.start_parquet(S.stream_links(pages, "core"), out, scratch_path(spark, "commits")).awaitTermination()
    return spark.read.parquet(out).distinct()


def stream_unique(spark, sf_dir):
    source = _page_source(spark, P.captured_pages(spark, sf_dir))
    out = scratch_path(spark, "stream-unique")
    pages = S.stream_pages(spark, source, "url string, html string", max_files=2)
    lines = sinks.with_line(S.stream_links(pages, "core")).select("line")
    S.start_parquet(S.stream_unique(lines, ["line"]), out, scratch_path(spark, "commits")).awaitTermination()
    return spark.read.parquet(out)


def stream_bloom_unique(spark, sf_dir):
    """Customer hosts of orders as they arrive, each passed on once as far as the filter can tell."""
    lines = P.table(spark, sf_dir, "orders").select(F.concat(F.lit("https://c"), P.text(F.col("o_custkey")), F.lit(".example.com/")).alias("line"))
    source = _stream_source(spark, lines)
    out, filters = scratch_path(spark, "stream-lines"), scratch_path(spark, "stream-filters")
    arriving = S.stream_pages(spark, source, "line string", max_files=2)
    # an error rate at which no two of these lines are taken for each other, so that SQL can tell
    spec = D.ScalableSpec(error_rate=1e-9, capacity=1000)
    S.start_bloom_unique(arriving, filters, out, scratch_path(spark, "commits"), spec).awaitTermination()
    return spark.read.parquet(out).select("line")


def stream_unique_delay(spark, sf_dir):
    """Event types of each user, repeats dropped within a delay longer than the table covers."""
    events = P.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    source, out = _stream_source(spark, events), scratch_path(spark, "stream-delay")
    rows = S.stream_pages(spark, source, "user_id bigint, event_type string, ts timestamp")
    unique = S.stream_unique(rows, ["user_id", "event_type"], event_time="ts", delay="36500 days")
    S.start_parquet(unique, out, scratch_path(spark, "commits")).awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type")


def stream_history(spark, sf_dir):
    source = _stream_source(spark, _all_seeds(spark, sf_dir))
    out, history = scratch_path(spark, "stream-seeds"), scratch_path(spark, "stream-history")
    seeds = S.stream_pages(spark, source, "seed string", max_files=2)
    S.start_history(seeds, history, out, scratch_path(spark, "commits")).awaitTermination()
    return spark.read.parquet(out).select("seed")


def registered() -> dict[str, Query]:
    plain = {
        "py_hrefs": _plain_query(R.PLAIN_HREF),
        "py_scripts": _plain_query(R.PLAIN_SCRIPT),
        "py_styles": _plain_query(R.PLAIN_STYLE),
    }
    texts = {
        "urls_in_text": _text_query(T.urls_in_text),
        "http_urls_in_text": _text_query(T.http_urls_in_text),
        "origins_in_text": _text_query(T.origins_in_text),
        "css_urls": _text_query(T.css_urls),
    }
    profiles = {
        "extract_core": _extract_query("core"),
        "extract_full": _extract_query("full"),
        "classify_exclusive": _extract_query("exclusive"),
        "classify_grouped": _extract_query("grouped"),
        "extract_py": _extract_query("py"),
    }
    labels = {f"link_{name}": _link_query(label) for label, name in LABELS.items()}
    labels["link_custom_REGEX_element"] = _link_query(R.PAGE_TEXT, text_scope="element")
    others = (
        seeds_valid, seeds_rejected, keywords_read, pages_read, hosts_parsed, sink_lines, sink_json, sink_filtered, sink_both,
        sink_by_depth, link_anchor, inside_path_full, scope_host_extra, absolute_url_encoded, alive_two_attempts,
        host_of, main_domain, seed_domain, absolute_url, absolute_url_base, parse_headers, truncate_body,
        render_line, render_json, is_textual, gate_textual, py_third_party, py_links, py_depths,
        kw_filter, kw_filter_line, inside_path, scope_host, scope_subs, scope_host_list, kw_matches,
        kw_filter_table, seeds_unprocessed, history_append, history_append_files, history_merge, history_domains, unique_lines,
        bloom_seen, bloom_persist, crawl_visited, crawl_depth, crawl_multi, crawl_resume, alive_strict,
        alive_tolerant, retry_backoff, seed_status, within_budget, stream_extract, stream_unique, stream_bloom_unique, stream_unique_delay, stream_history,
    )
    return {
        "html_elements": elements, **labels, **profiles, **plain, **texts,
        **{f.__name__: f for f in others},
    }
