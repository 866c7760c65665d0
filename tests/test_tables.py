"""Lookups, de-duplication, history, crawl and fetch log against brute force."""

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.operators import crawl as C
from linkloom.operators import dedupe as D
from linkloom.operators import fetchlog as L
from linkloom.operators import filters as FL
from linkloom.operators import history as H
from linkloom.operators import lookups as K
from linkloom.operators.skew import salted_join
from linkloom.session import cut_lineage
from linkloom.sources import buckets, readers, sinks

NOW = dt.datetime(2024, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def words(spark, values, name):
    return frame(spark, [(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("seed", [1, 2])
def test_keyword_matches(spark, seed):
    rng = random.Random(seed)
    make = lambda low, high: "".join(rng.choice("ab.") for _ in range(rng.randint(low, high)))
    texts = [make(0, 30) for _ in range(60)] + ["a" * 70, "a" * 70]
    needles = {make(1, 6) for _ in range(25)} | {"a" * 40, "é", ""}
    got = K.keyword_matches(words(spark, texts, "raw"), words(spark, sorted(needles), "keyword")).collect()
    want = sorted((t, n) for t in texts for n in needles if n in t)
    assert sorted((r["raw"], r["keyword"]) for r in got) == want
    some = sorted(needles - {"", "a", "b", "."})
    kept = K.keyword_semi_join(words(spark, texts, "raw"), words(spark, some, "keyword"))
    assert sorted(r[0] for r in kept.collect()) == sorted(t for t in texts if any(n in t for n in some))


def test_keywords_are_indexed_under_their_rarest_run(spark):
    needles = [f"api.example.com/{i}x" for i in range(50)] + ["zz", "q", "é.ü", "api", "zz"]
    index = {r["keyword"]: r["_gram"] for r in K.gram_index(words(spark, needles, "keyword"), "keyword").collect()}
    assert set(index) == set(needles) and all(g in n and len(g) == min(3, len(n)) for n, g in index.items())
    count = lambda g: sum(g in n for n in index)
    for n, g in index.items():
        assert count(g) == min(count(n[k : k + len(g)]) for k in range(len(n) - len(g) + 1)), n
    # a text gives no more rows than it has characters, whatever the lengths of the keywords
    texts = words(spark, ["http://api.example.com/17x?q=é.ü" * 3, "aaaa", "", "ab"], "raw")
    runs = K._runs(texts, "raw", [3]).groupBy("raw").count().collect()
    assert {r["raw"]: r["count"] for r in runs}["aaaa"] == 1 and all(r["count"] <= len(r["raw"]) for r in runs)


def test_keyword_edge_cases(spark):
    texts = words(spark, ["x", "y", None], "raw")
    none = words(spark, [], "keyword")
    assert K.keyword_matches(texts, none).count() == 0
    assert K.keyword_semi_join(texts, none).count() == 3
    assert K.keyword_matches(texts, words(spark, [""], "keyword")).count() == 2
    many = [f"k{i}" for i in range(5000)] + ["x"]
    assert [r[0] for r in texts.where(FL.keyword_predicate(F.col("raw"), many)).collect()] == ["x"]


def test_keywords_with_one_prefix_meet_only_their_texts(spark):
    needles = [f"api.example.com/v/{i}" for i in range(1000)]
    texts = [f"http://api.example.com/v/{i}" for i in range(0, 3000, 7)]
    got = K.keyword_matches(words(spark, texts, "raw"), words(spark, needles, "keyword"))
    want = sorted((t, n) for t in texts for n in needles if n in t)
    assert sorted((r["raw"], r["keyword"]) for r in got.collect()) == want


def test_salt_parts_equal_rows(spark):
    rows = spark.range(0, 100_000, 1, 32).select(F.lit("h").alias("host"))
    salts = rows.select(F.pmod(F.xxhash64(F.spark_partition_id(), "host"), F.lit(8)).alias("s")).distinct().count()
    assert salts > 4
    assert salted_join(rows, words(spark, ["h"], "host"), "host").count() == 100_000


def test_crawl_meets_pages_by_what_a_fetch_asks_for(spark):
    html = '<a href="/2#sec">a</a><a href="http://h/a/../3">b</a><a href="HTTP://H:80">c</a>'
    rows = [("http://h/1", html), ("http://h/2", ""), ("http://h/3", ""), ("http://h/", "")]
    result = C.crawl(frame(spark, rows, "url string, html string"), words(spark, ["http://h/1#top"], "seed"), depth=2)
    assert sorted((r["url"], r["depth"]) for r in result.visited.collect()) == [
        ("http://h/", 2), ("http://h/1", 1), ("http://h/2", 2), ("http://h/3", 2)
    ]


def test_scope_host_list(spark):
    hosts = ["a.com", "b.org", "a.co", "x"]
    urls = ["http://a.com/", "http://www.a.com.evil/", "http://xa.com/", "http://q/?u=//b.org", "http://b.or", "ftp://x", ""]
    want = sorted(u for u in urls if any("." + h in u or "//" + h in u for h in hosts))
    got = K.scope_host_list(words(spark, urls, "url"), words(spark, hosts, "host"))
    assert sorted(r["url"] for r in got.collect()) == want
    one = words(spark, urls, "url").where(FL.in_scope_subdomains(F.col("url"), F.lit("a.com")))
    assert sorted(r[0] for r in one.collect()) == ["http://a.com/", "http://www.a.com.evil/"]


def test_bloom(spark):
    spec = D.BloomSpec(2000, 0.01)
    assert (spec.bits, spec.hashes) == (19171, 7)
    assert (D.BloomSpec().bits, D.BloomSpec().hashes) == (9585059, 7)
    put = frame(spark, [(f"in{i}",) for i in range(2000)], "line string")
    other = frame(spark, [(f"out{i}",) for i in range(5000)], "line string")
    halves = [D.bloom_build(put.where(F.length("line") % 2 == i), spec) for i in range(2)]
    table = D.bloom_merge(*halves)
    assert D.bloom_test(put, table, spec).where("not seen").count() == 0
    assert D.bloom_test(other, table, spec).where("seen").count() < 0.02 * 5000
    assert D.bloom_unique(put.unionByName(put), table, spec).count() == 0
    empty = D.bloom_build(put.where("false"), spec)
    assert D.bloom_unique(put.unionByName(put), empty, spec).count() == 2000


@pytest.mark.parametrize("times", [10, 100])
def test_growing_bloom_keeps_its_error_rate(spark, times):
    """Far more lines than the first slice takes: the error rate holds, in one run and over several with stored filters."""
    spec = D.ScalableSpec(capacity=200)
    put = spark.range(200 * times).select(F.concat(F.lit("in"), "id").alias("line"))
    other = spark.range(20_000).select(F.concat(F.lit("out"), "id").alias("line"))
    once = cut_lineage(D.scalable_add(put.unionByName(put), spec=spec))
    third = lambda i: put.where(F.pmod(F.xxhash64("line"), F.lit(3)) == i)
    runs = None
    for i in range(3):
        runs = cut_lineage(D.scalable_add(third(i), runs, spec))
    for filters in (once, runs):
        assert D.scalable_test(put, filters, spec).where("not seen").count() == 0
        assert D.scalable_test(other, filters, spec).where("seen").count() < 0.02 * 20_000
        # a line taken for a repeat is not put in
        assert 0.98 * 200 * times <= filters.agg(F.sum("lines")).first()[0] <= 200 * times
        assert filters.select("slice").distinct().count() > 1
    again = D.scalable_add(put, once, spec)
    assert again.agg(F.sum("lines")).first()[0] == once.agg(F.sum("lines")).first()[0]


def test_growing_bloom_edge_cases(spark):
    none = words(spark, [], "line")
    empty = D.scalable_add(none)
    assert empty.count() == 0 and D.scalable_unique(words(spark, ["a", "a", "b"], "line"), empty).count() == 2
    filters = D.scalable_add(words(spark, ["a", None, "a"], "line"), empty)
    assert {tuple(r) for r in D.scalable_test(words(spark, ["a", "", None], "line"), filters).collect()} == {("a", True), ("", False), (None, False)}
    assert [n for _, n in D.ScalableSpec(10, growth=2).shares({0: 10, 1: 5}, 100)] == [15, 40, 45]


def test_bloom_large_capacity_has_many_blocks():
    assert D.BloomSpec(100_000_000).blocks == 29252


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    assert readers.read_history(spark, path).count() == 0
    seeds = frame(spark, [("u1",), ("u1",), ("u2",)], "seed string")
    sinks.append_history(readers.read_history(spark, path), H.new_entries(seeds, F.lit(NOW)), path)
    later = frame(spark, [("u2", "s", NOW), ("u3", "s", NOW + dt.timedelta(1)), ("u3", "r", NOW)], readers.HISTORY_SCHEMA)
    sinks.append_history(readers.read_history(spark, path), later, path)
    rows = {(r["url"], r["source"]) for r in readers.read_history(spark, path).collect()}
    assert rows == {("u1", None), ("u2", None), ("u3", "r")}
    assert K.unprocessed_seeds(seeds.union(words(spark, ["u9", "u9"], "seed")), readers.read_history(spark, path)).collect() == [("u9",)]


def test_bucketed_history(spark, tmp_path):
    path = str(tmp_path / "it's a history")
    assert buckets.bucketed_history(spark, path, 4).count() == 0
    urls = [(f"u{i}", None, NOW) for i in range(200)] + [("u1", "s", NOW - dt.timedelta(1)), (None, "s", NOW)]
    buckets.append_bucketed(spark, frame(spark, urls, readers.HISTORY_SCHEMA), path, 4)
    later = [(f"u{i}", "late", NOW + dt.timedelta(1)) for i in range(100, 300)]
    buckets.append_bucketed(spark, frame(spark, later, readers.HISTORY_SCHEMA), path, 4)
    rows = buckets.bucketed_history(spark, path, 4)
    got = {r["url"]: (r["source"], r["ts"]) for r in rows.collect()}
    assert rows.count() == len(got) == 301 and got["u1"] == ("s", NOW - dt.timedelta(1))
    assert got["u150"][0] is None and got["u250"][0] == "late"
    # what is stored is met in place, also where the session would use more partitions
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("-1", "32")):
            spark.conf.set(n, v)
        missing = buckets.missing_from(rows, frame(spark, later, readers.HISTORY_SCHEMA), 4)
        plan = missing._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert "LeftOuter" in plan and "Bucketed: true" in plan
    new, stored = plan.split("Scan ExistingRDD")
    assert "Exchange" in new and "Exchange" not in stored and "FileScan parquet" in stored, plan


def test_merge_order_does_not_matter(spark):
    rows = [("b", "u", "x", NOW), ("main", "u", "y", NOW), ("a", "v", "p", NOW), ("b", "v", "q", NOW)]
    want = {("main", "u", "y"), ("a", "v", "p")}
    for order in (rows, rows[::-1]):
        merged = H.merge_histories(frame(spark, order, "db_name string, url string, source string, ts timestamp"), "main")
        assert {(r["db_name"], r["url"], r["source"]) for r in merged.collect()} == want


def walk(graph, seed, depth, allowed):
    seen, queue = {seed: 1}, deque([seed])
    while queue:
        at = queue.popleft()
        if seen[at] == depth:
            continue
        for to in graph.get(at, ()):
            if to in graph and to not in seen and allowed(seed, to):
                seen[to] = seen[at] + 1
                queue.append(to)
    return seen


@pytest.mark.parametrize("kind", ["host", "subs", "inside", "extra"])
def test_crawl_against_breadth_first_search(spark, kind):
    rng = random.Random(3)
    hosts = ["h.com", "a.h.com", "o.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['', 'd/'])}{i}" for i in range(40)]
    graph = {u: rng.sample(urls, 4) + [f"http://h.com/missing{i}"] for i, u in enumerate(urls)}
    pages = frame(spark, [(u, "".join(f"<a href='{t}'>" for t in ts)) for u, ts in graph.items()], "url string, html string")
    seeds = urls[:6] + [urls[0], "http://h.com/nowhere", "not a url"]
    host = lambda u: u.split("/")[2]
    allowed, options = {
        "host": (lambda s, t: host(s) == host(t), {}),
        "subs": (lambda s, t: "." + host(s) in t or "//" + host(s) in t, {"subdomains": True}),
        "inside": (lambda s, t: host(s) == host(t) and s in t, {"inside": True}),
        "extra": (lambda s, t: host(t) in (host(s), "o.org"), {"extra_hosts": ["o.org"]}),
    }[kind]
    result = C.crawl(pages, words(spark, seeds, "seed"), 4, profile="core", **options)
    want = {(s, u, d) for s in set(seeds) if s in graph for u, d in walk(graph, s, 4, allowed).items()}
    assert {tuple(r) for r in result.visited.select("seed", "url", "depth").collect()} == want
    if kind != "inside":
        edges = {(s, t, u, d) for s, u, d in want for t in graph[u]}
        found = result.links.where("source = 'href'").select("seed", "url", "where_url", "depth")
        assert {tuple(r) for r in found.collect()} == edges


@pytest.mark.parametrize("numbered", [1 << 16, 100])
def test_crawl_keeps_seeds_of_one_host_as_bits(spark, monkeypatch, numbered):
    """1,000 seeds of a host, and one of another: sets of them walk together, rows come out per seed."""
    monkeypatch.setattr(C, "_NUMBERED", numbered)
    graph = {f"http://h/{i}": [f"http://h/{i * 7 % 1000}", f"http://h/{i // 30}", "http://g/0"] for i in range(1000)}
    graph["http://g/0"] = ["http://h/1", "http://g/1"]
    graph["http://g/1"] = []
    pages = frame(spark, [(u, "".join(f"<a href='{t}'>" for t in ts)) for u, ts in graph.items()], "url string, html string")
    seeds = [u for u in graph if u != "http://g/1"]
    result = C.crawl(pages, words(spark, seeds * 2, "seed"), 5, profile="core")
    same = lambda s, t: s.split("/")[2] == t.split("/")[2]
    want = {s: walk(graph, s, 5, same) for s in seeds}
    got = [tuple(r) for r in result.visited.collect()]
    assert sorted(got) == sorted((s, u, d) for s, found in want.items() for u, d in found.items())
    lines = result.links.where("source = 'href'").select("seed", "url", "where_url", "depth")
    assert {tuple(r) for r in lines.collect()} == {(s, t, u, d) for s, u, d in got for t in graph[u]}
    # a seed's own page is a row for each seed; pages that many reach are not
    later = [r for r in result.reached.collect() if r["depth"] > 1]
    assert sum(bin(r["bits"] & (1 << 64) - 1).count("1") for r in later) == sum(len(found) - 1 for found in want.values())
    shared = [r for r in later if r["url"] in {f"http://h/{i}" for i in range(2)}]
    reached_by = sum(1 for s, u, d in got if d > 1 and u in {f"http://h/{i}" for i in range(2)})
    assert 5 * len(shared) <= reached_by


def test_resume_records_seeds_without_pages(spark):
    pages = frame(spark, [("http://h/1", "<a href=/2>"), ("http://h/2", "")], "url string, html string")
    seeds = words(spark, ["http://h/1", "http://h/2", "http://h/gone"], "seed")
    done = frame(spark, [("http://h/2", None, NOW)], readers.HISTORY_SCHEMA)
    result, history = C.resume(pages, seeds, done, 2, profile="core")
    assert {(r["seed"], r["url"]) for r in result.visited.collect()} == {("http://h/1", "http://h/1"), ("http://h/1", "http://h/2")}
    assert sorted(r["url"] for r in history.collect()) == ["http://h/1", "http://h/2", "http://h/gone"]
    again, same = C.resume(pages, seeds, history, 2, profile="core")
    assert again.visited.count() == 0 and same.count() == 3


LOG = [
    ("ok", 1, 200), ("moved", 1, 302), ("late", 1, None), ("late", 2, 429), ("late", 3, 503), ("late", 4, 200),
    ("fifth", 1, 500), ("fifth", 2, 500), ("fifth", 3, 500), ("fifth", 4, 500), ("fifth", 5, 200),
    ("dead", 1, 100), ("dead", 2, 404), ("dead", 3, 200), ("gap", 3, 200),
]


def test_fetch_log(spark):
    log = frame(spark, LOG, "url string, attempt int, status int")
    values = lambda df: {r[0]: r[1] for r in df.collect()}
    assert values(L.alive_strict(log)) == {"ok": True, "moved": False, "late": False, "fifth": False, "dead": False, "gap": True}
    assert values(L.alive_tolerant(log)) == {"ok": True, "moved": True, "late": True, "fifth": False, "dead": False, "gap": True}
    assert values(L.alive_tolerant(log, 2)) == {"ok": True, "moved": True, "late": False, "fifth": False, "dead": False, "gap": False}
    assert values(L.retry_backoff(log)) == {"ok": 0, "moved": 0, "late": 45, "fifth": 40, "dead": 5, "gap": 0}


def test_seed_status_and_budget(spark):
    log = frame(spark, [("http://ok/", 1, 200), ("http://no/", 1, 404)], "url string, attempt int, status int")
    seeds = words(spark, ["http://ok/", "http://no/", "http://new/", "bad"], "seed")
    assert {r[0]: r[1] for r in L.seed_status(seeds, log, alive="ALIVE", dead="TIMEOUT").collect()} == {
        "http://ok/": "ALIVE", "http://no/": "TIMEOUT", "http://new/": "TIMEOUT", "bad": "INVALID URL",
    }
    rows = [("s", NOW + dt.timedelta(seconds=i)) for i in range(10)] + [("t", NOW + dt.timedelta(seconds=50))]
    results = frame(spark, rows, "seed string, ts timestamp")
    assert L.within_budget(results, 6).count() == 8
    assert L.within_budget(results, -1).count() == 11


def test_hot_seed_is_split(spark):
    """A third of the rows under one seed: the join has several partitions of it."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("-1", "false")):
        spark.conf.set(n, v)
    try:
        at = F.col("id")
        seed = F.when(at % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (at % 500).cast("string")))
        rows = spark.range(30_000).select(seed.alias("seed"), F.timestamp_seconds(at).alias("ts"), at)
        kept = L.within_budget(rows, 10_000)
        got = kept.groupBy("seed").count().collect()
        tasks = kept.where("seed = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    first = {}
    for i in range(30_000):
        first.setdefault("hot" if i % 3 == 0 else f"s{i % 500}", []).append(i)
    assert {r["seed"]: r["count"] for r in got} == {s: sum(i <= v[0] + 10_000 for i in v) for s, v in first.items()}
    assert tasks > 2


def test_hosts(spark, tmp_path):
    path = tmp_path / "hosts.txt"
    path.write_text("a.com\nb_c.d.net\nsingle\nx.a.coma.com\nxa.com\nn.x.coma.com.\n")
    rows = {r["host"]: (r["domain2"], r["well_formed"]) for r in readers.read_hosts(spark, str(path)).collect()}
    assert rows["a.com"] == ("a_com", True) and rows["b_c.d.net"] == ("d_net", True)
    assert rows["single"] == (None, False) and rows["x.a.coma.com"][1] is False and rows["xa.com"][1] is True


def test_text_sources_and_sinks(spark, tmp_path):
    seeds = tmp_path / "seeds"
    seeds.mkdir()
    (seeds / "one").write_text("http://a/\nb.com\n\n")
    (seeds / "two").write_text("http://a/\nmailto:x\n")
    assert sorted(tuple(r) for r in readers.read_seeds(spark, str(seeds)).collect()) == [
        ("http://a/", "a"), ("http://a/", "a"), ("mailto:x", ""),
    ]
    assert sorted(r[0] for r in readers.rejected_seeds(spark, str(seeds)).collect()) == ["", "b.com"]
    (tmp_path / "kw").write_text(" a \n\nb\n")
    assert sorted(r[0] for r in readers.read_keywords(spark, str(tmp_path / "kw")).collect()) == ["", " a ", "b"]
    links = frame(spark, [("href", "http://a/1", "http://w:8/"), ("css", "http://b/2", "http://w:8/")], "source string, url string, where_url string")
    lines = sinks.with_line(links, show_source=True)
    out = str(tmp_path / "out")
    sinks.write_lines(lines, out)
    sinks.write_lines(lines, out, keywords=["css"])
    assert readers.read_lines(spark, out, "line").count() == 3
    sinks.write_lines(lines, out, mode="overwrite")
    assert readers.read_lines(spark, out, "line").count() == 2
    sinks.write_filtered(lines, ["css"], str(tmp_path / "both"))
    assert readers.read_filtered(spark, str(tmp_path / "both"), full=True).count() == 2
    assert readers.read_filtered(spark, str(tmp_path / "both")).collect() == [("[css] http://b/2",)]
    sinks.write_filtered(lines, ["css"], str(tmp_path / "both"), keep_full=False)
    assert readers.read_filtered(spark, str(tmp_path / "both"), full=True).collect() == [("[css] http://b/2",)]
    sinks.write_by_depth(links.withColumn("depth", F.lit(1)), str(tmp_path / "depth"))
    assert (tmp_path / "depth/domain=w_8/depth=1").is_dir()


def test_fetch_form_agrees_with_the_long_way(spark):
    rng = random.Random(2)
    parts = ["http://", "https://", "HTTP://", "ftp://", "a.com", "A.com", "u@b", ":80", ":443", "/", "/.", "/..", "x", ".y", "?q=/./z", "#f", "é", "[::1]", "a_b-c"]
    urls = ["http://" + "".join(rng.choice(parts[4:]) for _ in range(rng.randint(0, 5))) for _ in range(300)]
    urls += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(300)] + ["http://a.com/\n", "http://a.com/x\ny"]
    url = F.col("url")
    rows = words(spark, urls, "url").select("url", U.fetch_key(url).alias("short"), U._fetch_key(url).alias("long"), C._host(U.fetch_key(url)).alias("host"), U.host_of(U._fetch_key(url)).alias("want"))
    for r in rows.collect():
        assert r["short"] == r["long"] and r["host"] == r["want"], r


def test_crawl_parses_only_reached_pages(spark, monkeypatch):
    """With subdomains in scope too: two seeds of a corpus of many pages, each page parsed once."""
    rows = [(f"http://h{h}.org/{i}", f"<a href=/{i + 1}><a href=/{i}><a href='http://w.h{h}.org/{i}'>") for h in range(6) for i in range(9)]
    rows += [(f"http://w.h{h}.org/{i}", f"<a href='http://h{h}.org/{i + 1}'>") for h in range(6) for i in range(9)]
    pages, seeds = frame(spark, rows, "url string, html string"), words(spark, ["http://h1.org/0", "http://h3.org/5", "http://h3.org/6"], "seed")
    parsed = []
    parse = C._parse
    monkeypatch.setattr(C, "_parse", lambda p, *rest: parsed.extend(r["url"] for r in p.select("url").collect()) or parse(p, *rest))
    graph = {u: [t.replace("href=", "").strip("'") for t in h.split("<a ")[1:]] for u, h in rows}
    host = lambda u: u.split("/")[2]
    full = {u: [t.rstrip(">").strip("'") if t.startswith(("http", "'")) else f"http://{host(u)}{t.rstrip('>')}" for t in ts] for u, ts in graph.items()}
    for options, allowed in (({"subdomains": True}, lambda s, t: "." + host(s) in t or "//" + host(s) in t), ({}, lambda s, t: host(s) == host(t))):
        parsed.clear()
        result = C.crawl(pages, seeds, 3, profile="core", **options)
        want = {(s, u, d) for s in ("http://h1.org/0", "http://h3.org/5", "http://h3.org/6") for u, d in walk(full, s, 3, allowed).items()}
        assert {tuple(r) for r in result.visited.select("seed", "url", "depth").collect()} == want
        assert sorted(parsed) == sorted({u for _, u, _ in want})


def test_crawl_of_nothing(spark):
    pages = frame(spark, [("http://h/1", "<a href=/1>")], "url string, html string")
    for p, s in ((pages, []), (pages, ["http://g/"]), (pages.where("false"), ["http://h/1"])):
        result = C.crawl(p, words(spark, s, "seed"), 3, profile="core")
        assert result.visited.count() == 0 and result.links.count() == 0


def test_keyword_runs_grow_with_the_list(spark):
    needles = ["".join("ab"[i >> k & 1] for k in range(10)) for i in range(1024)]
    index = K.gram_index(words(spark, needles, "keyword"), "keyword").collect()
    listed = {}
    for r in index:
        listed.setdefault(r["_gram"], set()).add(r["keyword"])
    assert all(g in n for g, having in listed.items() for n in having)
    assert sum(map(len, listed.values())) == 1024 and max(map(len, listed.values())) <= K.LISTED
    texts = ["".join(random.Random(i).choice("ab") for _ in range(14)) for i in range(20)]
    got = K.keyword_matches(words(spark, texts, "raw"), words(spark, needles, "keyword")).collect()
    assert sorted((r["raw"], r["keyword"]) for r in got) == sorted((t, n) for t in texts for n in needles if n in t)


def test_links_of_a_crawl_are_not_shuffled_per_seed(spark):
    html = '<a href="/2">a</a><a href="/2">b</a><img src="/2"><a href="/9">c</a>'
    pages = frame(spark, [("http://h/1", html), ("http://h/2", html)], "url string, html string")
    result = C.crawl(pages, words(spark, ["http://h/1", "http://h/2"], "seed"), depth=2, profile="core", inside=True)
    assert sorted(tuple(r) for r in result.links.select("seed", "source", "url", "depth").collect()) == [
        ("http://h/1", "embedded", "http://h/2", 1), ("http://h/2", "embedded", "http://h/2", 1), ("http://h/2", "href", "http://h/2", 1)
    ]
    plan = result.links._jdf.queryExecution().optimizedPlan().toString()
    assert "bits" not in "".join(line for line in plan.splitlines() if "Aggregate" in line)


def test_a_longer_table_is_spread_over_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(0, 2000, 1, 1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(readers, "SPREAD_ROWS", 100)
    rows = readers.spread(spark.read.parquet(str(tmp_path / "t")))
    assert rows.rdd.getNumPartitions() == 20 and rows.distinct().count() == 2000
