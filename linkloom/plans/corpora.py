"""Inputs derived from the given tables, for constructs the tables lack.

Every row comes from a row of a table, so each input grows with its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(key: Column) -> Column:
    return key.cast("string")


def pick(key: Column, *choices: Column | str) -> Column:
    """One of ``choices`` by the remainder of ``key``."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, choice in enumerate(choices):
        chosen = chosen.when(F.pmod(key, F.lit(len(choices))) == i, choice if isinstance(choice, Column) else F.lit(choice))
    return chosen


SHOP_HOSTS = ("shop.example.com", "www.shop.example.com", "example.org", "cdn.example.net")


def shop_url(key: Column) -> Column:
    return F.concat(F.lit("https://"), pick(key, *SHOP_HOSTS), F.lit("/p/"), text(key))


# One page per part. {k} is the key, {w} the page's own URL; {next}, {back} and
# {cross} are the pages of k + 4, k - 4 and 2k.
SHOP_PAGE = """<html><head>{base}
<link rel="stylesheet" href="/s/{k}.css"><link rel="manifest" href="/m/{k}.json">
<link type="application/rss+xml" href="/f/{k}.rss">
<meta name="viewport" content="w{k}"><meta property="og:image" content="/og/{k}.png">
<meta name="twitter:image" content="/tw/{k}.png">
<script src="/js/{k}.js"></script><script src="wss://ws.example.com/{k}"></script>
<script src="https://lib.example.com/{k}.js"></script>
<script>var u="https://api.example.com/v/{k}?a=1&b=2";</script></head>
<body background="/bg/{k}.gif"><!-- <a href="/hidden/{k}">no</a> -->
<a href="{next}">next</a><a href="{back}">back</a>
<a href="{cross}">cross</a><a href="#top">frag</a><a href="">empty</a>
<a href='sub/{k}.xml'>map</a><a href="../up/{k}">up</a><A HREF=/bare/{k}>bare</A>
<a href="/q?x=1&amp;y={k}">amp</a><button href="https://b.example.com/{k}">b</button>
<form action="/post/{k}"></form><img src="/i/{k}.webp"><img src="data:image/gif;base64,AA{k}">
<iframe src="//frames.example.net/{k}"></iframe><video src="/v/{k}.mp4"></video>
<audio src="/a/{k}.mp3"></audio><embed src="/e/{k}"><track src="/t/{k}.vtt">
<area href="/ar/{k}"><applet archive="/ap/{k}.jar"></applet><bgsound src="/bgs/{k}">
<frame src="/fr/{k}"><frameset frameborder="1" src="/fs/{k}"></frameset>
<div data-x="1">/d/{k}</div><div data-custom-x="1">/dc/{k}</div>
<div data-y=1><b>/dn/{k}</b></div><div data-custom-y=1>/dc<i>n/{k}</i></div>
<p>x <span><b>http://n.example.com/{k}</b>-2</span>-3
<p style="background:url('/css/{k}.png')">see ftp://files.example.org/{k} end</p></body></html>"""


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, html)``, one page per part."""
    k = F.col("p_partkey")
    html = F.lit(SHOP_PAGE)
    base = F.when(F.pmod(k, F.lit(10)) == 0, F.concat(F.lit('<base href="'), shop_url(k), F.lit('">'))).otherwise("")
    for mark, value in (
        ("{base}", base), ("{k}", text(k)), ("{next}", shop_url(k + 4)),
        ("{back}", shop_url(k - 4)), ("{cross}", shop_url(k * 2)),
    ):
        html = F.replace(html, F.lit(mark), value)
    # the keys are spread, not the pages made from them
    keys = spread(table(spark, sf_dir, "part").select("p_partkey"))
    return keys.select(shop_url(k).alias("url"), html.alias("html"))


def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, html)``: the pages table and the shop pages."""
    pages = spread(table(spark, sf_dir, "pages").select("url", "html"))
    return pages.unionByName(shop_pages(spark, sf_dir))


def based_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two ``<base href>`` and one base without, one page per part."""
    k = text(F.col("p_partkey"))
    html = F.replace(
        F.lit(
            '<html><head><base target="t"><base href="/base{k}/x"><base href="/late/"></head>'
            '<body><a href="y">1</a><a href="?q={k}">2</a><img src="../i.png"></body></html>'
        ),
        F.lit("{k}"), k,
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("http://h"), k, F.lit(".example.com/a/b")).alias("url"), html.alias("html")
    )


def seed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seed)``: good and bad seed lines, with repeats, from orders."""
    c = text(F.col("o_custkey"))
    seed = pick(
        F.col("o_orderkey"),
        F.concat(F.lit("https://c"), c, F.lit(".example.com/")),
        F.concat(F.lit("c"), c, F.lit(".example.com")),
        F.concat(F.lit("mailto:c"), c),
        "",
        F.concat(F.lit("http://u:p@h"), c, F.lit(".example.com:8080/a")),
        F.concat(F.lit("//x/"), c),
        F.concat(F.lit("https://[2001:db8::"), c, F.lit("]:8443/")),
    )
    return table(spark, sf_dir, "orders").select(seed.alias("seed"))


def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(keyword)``: keyword lines with blanks around, and empty ones, from suppliers."""
    s = text(F.col("s_suppkey"))
    word = pick(F.col("s_suppkey"), F.concat(F.lit(" k"), s, F.lit(" ")), "", F.concat(F.lit("/K"), s))
    return table(spark, sf_dir, "supplier").select(word.alias("keyword"))


def url_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url)``: page URLs and seed lines."""
    return (
        table(spark, sf_dir, "pages").select("url")
        .unionByName(seed_lines(spark, sf_dir).withColumnRenamed("seed", "url"))
    )


def host_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = text(F.col("c_custkey"))
    host = pick(
        F.col("c_custkey"),
        F.concat(F.lit("a"), k, F.lit(".b.example.com")),
        F.concat(F.lit("x_y"), k, F.lit(".example.org")),
        F.concat(F.lit("single"), k),
        F.concat(F.lit("h"), k, F.lit(".example.coma"), text(F.col("c_custkey") - 3), F.lit(".b.example.com")),
        F.concat(F.lit("www.h"), k, F.lit(".co.uk")),
    )
    return table(spark, sf_dir, "customer").select(host.alias("host"))


# Reference resolution examples of RFC 3986, section 5.4, and their results on
# http://{host}/b/c/d;p?q
RFC_BASE = "/b/c/d;p?q"
RFC_EXAMPLES = (
    ("g:h", "g:h"), ("g", "/b/c/g"), ("./g", "/b/c/g"), ("g/", "/b/c/g/"), ("/g", "/g"),
    ("//g", "http://g"), ("?y", "/b/c/d;p?y"), ("g?y", "/b/c/g?y"), ("g#s", "/b/c/g#s"),
    ("g?y#s", "/b/c/g?y#s"), (";x", "/b/c/;x"), ("g;x", "/b/c/g;x"), ("g;x?y#s", "/b/c/g;x?y#s"),
    ("", "/b/c/d;p?q"), (".", "/b/c/"), ("./", "/b/c/"), ("..", "/b/"), ("../", "/b/"),
    ("../g", "/b/g"), ("../..", "/"), ("../../", "/"), ("../../g", "/g"), ("../../../g", "/g"),
    ("../../../../g", "/g"), ("/./g", "/g"), ("/../g", "/g"), ("g.", "/b/c/g."), (".g", "/b/c/.g"),
    ("g..", "/b/c/g.."), ("..g", "/b/c/..g"), ("./../g", "/b/g"), ("./g/.", "/b/c/g/"),
    ("g/./h", "/b/c/g/h"), ("g/../h", "/b/c/h"), ("g;x=1/./y", "/b/c/g;x=1/y"),
    ("g;x=1/../y", "/b/c/y"), ("g?y/./x", "/b/c/g?y/./x"), ("g?y/../x", "/b/c/g?y/../x"),
    ("g#s/./x", "/b/c/g#s/./x"), ("g#s/../x", "/b/c/g#s/../x"), ("#s", None), ("é/ü", "/b/c/é/ü"),
)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(p_partkey, link, base)``."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        pick(k, *[link for link, _ in RFC_EXAMPLES]).alias("link"),
        F.concat(F.lit("http://h"), text(k), F.lit(RFC_BASE)).alias("base"),
    )


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(o_orderkey, raw)``."""
    k = text(F.col("o_orderkey"))
    raw = pick(
        F.col("o_orderkey"),
        F.concat(F.lit("A: b"), k, F.lit(";; C:d ")),
        F.concat(F.lit("A:b:"), k),
        F.concat(F.lit("junk;;A: b: "), k),
        F.concat(F.lit("nocolon"), k),
        F.concat(F.lit("A: 1;;A: "), k),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: whole documents with URLs of their own at the end."""
    d = text(F.col("doc_id"))
    tail = F.replace(
        F.lit(
            " see https://u:p@d{d}.example.com:8080/p?x=1#f, ftp://f{d}.example.org 'ws://[::1]:9/s' "
            "HTTP://D{d}.EXAMPLE.COM\nurl(\"/c/{d}.png\") url('c{d}.gif') url(bare) https://d{d}.example.com/p end"
        ),
        F.lit("{d}"), d,
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("text"))


def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, status, content_type)``."""
    e = F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "view", "text/html")
        .when(F.col("event_type") == "click", "application/javascript")
        .when(F.col("event_type") == "purchase", "application/javascript; charset=utf-8")
        .when(F.col("event_type") == "signup", "image/png")
        .otherwise("text/css")
    )
    status = F.when(F.pmod(e, F.lit(4)) == 1, 404).when(F.pmod(e, F.lit(4)) == 3, 500).otherwise(200)
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), kind.alias("content_type"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, attempt, status, ts)``: each eight events in a row are the
    attempts of one URL."""
    e, kind = F.col("event_id"), F.col("event_type")
    status = (
        F.when(F.pmod(e, F.lit(11)) == 0, F.lit(None).cast("int"))
        .when(F.pmod(e, F.lit(13)) == 0, F.lit(100))
        .when(kind == "view", 200)
        .when(kind == "purchase", 302)
        .when(kind == "signup", 404)
        .when(kind == "click", 429)
        .otherwise(503)
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://u"), text(F.floor(e / 8)), F.lit(".example.com/")).alias("url"),
        (F.pmod(e, F.lit(8)) + 1).cast("int").alias("attempt"),
        status.alias("status"),
        "ts",
    )


def budget_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seed, event_id, ts)``: what each user's seed produced and when."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://u"), text(F.col("user_id")), F.lit(".example.com/")).alias("seed"), "event_id", "ts"
    )


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(db_name, url, source, ts)``, one row per name and URL, from orders."""
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("crawler-"), text(F.pmod(F.col("o_orderkey"), F.lit(5)))).alias("db_name"),
        F.concat(F.lit("https://c"), text(F.col("o_custkey")), F.lit(".example.com/")).alias("url"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )
    return orders.groupBy("db_name", "url").agg(F.min("ts").alias("ts")).select(
        "db_name", "url", F.lit(None).cast("string").alias("source"), "ts"
    )


MAIN_HISTORY = "crawler-0"


def customer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(o_orderkey, url)``: links that name customers' hosts in several ways."""
    c = text(F.col("o_custkey"))
    url = pick(
        F.col("o_orderkey"),
        F.concat(F.lit("https://c"), c, F.lit(".example.com/a")),
        F.concat(F.lit("https://www.c"), c, F.lit(".example.com")),
        F.concat(F.lit("https://xc"), c, F.lit(".example.com/")),
        F.concat(F.lit("https://z.example.net/?u=//c"), c, F.lit(".example.com.evil")),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"))


def supplier_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("c"), text(F.col("s_suppkey")), F.lit(".example.com")).alias("host")
    )


def supplier_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords such as ``17.`` and ``/17?``, some of them long."""
    s = text(F.col("s_suppkey"))
    word = pick(
        F.col("s_suppkey"),
        F.concat(s, F.lit(".")),
        F.concat(F.lit("/"), s, F.lit("?")),
        F.concat(F.lit("api.example.com/v/"), s),
    )
    return table(spark, sf_dir, "supplier").select(word.alias("keyword"))
