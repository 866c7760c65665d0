"""Scalar functions against the standard library and brute force."""

import html
import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from linkloom import fixed
from linkloom.functions import render, text, urls
from linkloom.functions.entities import decode_entities
from linkloom.plans.corpora import RFC_BASE, RFC_EXAMPLES


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", expression(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_host_of(spark):
    cases = {
        "https://Exa_mple.com:80/a": "Exa_mple.com",
        "http://u:p@h.org?x": "h.org",
        "http://[2001:db8::1]:8/": "2001:db8::1",
        "mailto:a@b.c": "",
        "no-scheme.com/x": None,
        "//h/x": None,
        "http://a b/": None,
        "http://a/%zz": None,
        "http://a/\n": None,
        "": None,
        "http://h/a@b": "h",
    }
    assert column(spark, list(cases), urls.host_of) == list(cases.values())


def test_domains(spark):
    assert column(spark, ["http://a.b.co.uk/x", "http://single/", "x", None], urls.main_domain) == ["co_uk", None, None, None]
    assert column(spark, ["http://u@h:1/x", "h/x", "http://a//b/c"], urls.seed_domain) == ["u@h:1", "h", "b"]


def test_reference_resolution_examples(spark):
    base = f"http://a{RFC_BASE}"
    got = column(spark, [link for link, _ in RFC_EXAMPLES], lambda c: urls.absolute_url(c, F.lit(base)))
    want = [out if out is None or ":" in out else f"http://a{out}" for _, out in RFC_EXAMPLES]
    assert got == want


def test_reference_resolution_against_urljoin(spark):
    rng = random.Random(5)
    pieces = ["a", "b.html", ".", "..", "c;d", "é"]
    links = ["", "?q=1", "//h2/x", "https://o.org/p"]
    for _ in range(400):
        path = "/".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
        links.append(rng.choice(["", "/"]) + path + rng.choice(["", "/", "?x=/../y", "#f/../g", "?a#b"]))
    for base in ("http://h/a/b/c?q#f", "https://h:8/a/", "http://h", "http://h?x"):
        got = column(spark, links, lambda c: urls.absolute_url(c, F.lit(base), keep_fragment=True))
        assert got == [urljoin(base, link) for link in links], base


def test_resolution_options(spark):
    def at(c, **kw):
        return urls.absolute_url(c, F.lit("http://h/a/b"), **kw)

    assert column(spark, ["#x", " c\n", None], at) == [None, "http://h/a/c", None]
    assert column(spark, ["#x"], lambda c: at(c, keep_fragment=True)) == ["http://h/a/b#x"]
    assert column(spark, ["ü x"], lambda c: at(c, encode="path")) == ["http://h/a/%C3%BC%20x"]
    with pytest.raises(ValueError):
        at(F.lit("x"), encode="other")


def test_entities_against_unescape(spark):
    cases = [
        "a&amp;b", "&#38;&#x26;&#X26;", "&eacute;&copy;&copy", "&unknown; & &&amp;", "&#0;&#128;&#x110000;&#xD800;",
        "&#99999999999;", "&lt;&gt;&quot;&apos;", "&colon;&sol;", "plain", "", "&#;", "&#x;", "&", "&#65", "&nbsp;x",
    ]
    assert column(spark, cases, decode_entities) == [html.unescape(c) for c in cases]
    in_attribute = column(spark, ["?a=1&copy=2&lt;&copy"], lambda c: decode_entities(c, in_attribute=True))
    assert in_attribute == ["?a=1&copy=2<©"]


def test_parse_headers(spark):
    got = column(spark, ["A: b;;C:d", "A:b:c", "junk;;A: b", "none", "A: 1;;A: 2", "", " X :\ty "], render.parse_headers)
    assert got == [{"A": "b", "C": "d"}, {"A": "b:c"}, {"A": "b"}, None, {"A": "2"}, {}, {"X": "y"}]


@pytest.mark.parametrize("size", [1023, 1024, 1025, 1026, 1027])
def test_truncate_body(spark, size):
    bodies = ["a" * (size - 1) + c + "tail" for c in ("é", "€", "😀", "x")]
    want = [b.encode()[:1024].decode(errors="ignore") for b in bodies]
    assert column(spark, bodies, lambda c: text.truncate_body(c, 1)) == want
    assert column(spark, bodies, lambda c: text.truncate_body(c, -1)) == bodies


def test_rendering(spark):
    df = spark.createDataFrame([("http://h/?a&b<c>\"", "href", "http://w/")], "url string, source string, where_url string")
    url, source, where = F.col("url"), F.col("source"), F.col("where_url")
    row = df.select(
        render.render_line(url, source, where).alias("plain"),
        render.render_line(url, source, where, show_source=True, show_where=True).alias("both"),
        render.render_json(url, source, where).alias("json"),
        render.render_json(url, source, where, show_where=True).alias("full"),
    ).first()
    assert row["plain"] == 'http://h/?a&b<c>"'
    assert row["both"] == '[http://w/] [href] http://h/?a&b<c>"'
    assert row["json"] == '{"Source":"href","URL":"http://h/?a\\u0026b\\u003cc\\u003e\\"","Where":""}'
    assert row["full"].endswith('"Where":"http://w/"}')


TEXTS = [
    "see https://u:p@h.com:80/p?x#f, 'ftp://h/y' and DATA://x",
    "file:///no-host data:text/plain http://[::1]:8080/a https://a.b:99999/x",
    "http://a http://a wss://s/x?y\"z ssh://git@h/r",
    "",
]


def test_urls_in_text(spark):
    got = column(spark, TEXTS, text.urls_in_text)
    for value, found in zip(TEXTS, got):
        assert sorted(found) == sorted({m.group(0) for m in re.finditer(fixed.URL_PATTERN, value)})


def test_text_patterns_keep_repeats(spark):
    got = column(spark, ["http://a.com http://a.com#x https://b~"], text.http_urls_in_text)
    assert got == [["http://a.com http://a.com", "https://b"]]
    got = column(spark, ["http://a.com/x ftp://u@b.org:21/y http://nodot/ https://a.b-c.info9:70000"], text.origins_in_text)
    assert got == [["http://a.com", "ftp://u@b.org:21", "https://a.b-c.info9:7000"]]
    got = column(spark, ["url('a') url(\"b\") url(c) url('d\ne') url('')"], text.css_urls)
    assert got == [["a", "b", ""]]


def test_long_inputs_do_not_overflow_the_stack(spark):
    long = ["http://" + "a " * 200_000, "http://" + "a." * 50_000 + "com", "https://" + "x" * 300_000 + "?" + "y" * 300_000]
    for find in (text.urls_in_text, text.http_urls_in_text, text.origins_in_text, text.css_urls):
        assert len(column(spark, long, find)) == 3


def test_is_textual(spark):
    got = column(spark, ["text/html; charset=x", "application/javascript", "application/javascript;x", "image/png"], urls.is_textual)
    assert got == [True, True, False, False]


def test_origins_with_any_number_of_labels(spark):
    loose = re.compile(
        r"(?i)(?:https?|ftp|smtp)://(?:[!-9;-?A-~]+(?::[!-9;-?A-~]+)?@)?(?:xn--[0-9a-z]+|[0-9a-z_-]+\.)*"
        r"(?:xn--[0-9a-z]+|[0-9a-z-]+)\.(?:xn--[0-9a-z]+|[0-9a-z]{2,10})"
    )
    hosts = [
        "a.b", "a..bc", "a.b..cd.ef", "_x.y_z.com", "x_.com", "xn--abc.de.com", "xn--a.xn--b", "-.co", "a.b.c1.d-e", "a.bc.", ".a.bc",
        "a.bc..", "a_b.c_d.ef", "www.xn--p1ai", "a.verylonglabelhere.c", "www." * 140 + "com", "a." * 5000 + "org",
    ]
    got = column(spark, [f"see ftp://{h} end" for h in hosts], text.origins_in_text)
    assert got == [loose.findall(f"see ftp://{h} end") for h in hosts]


def test_all_named_references(spark):
    names = ["&check;", "&NotEqualTilde;", "&starf;", "&amp;", "&eacute", "&nosuch;"]
    got = column(spark, names, decode_entities)
    assert got == [html.unescape(n) for n in names]


def test_plain_links_resolve_as_all_do(spark):
    links = ["/a?b=1", "http://h/x", "https://h", "//h/x", "/./a", "/a/../b", "/a#f", "/%zz", "/a b", "/é", "http://h/..", "x", "", "/", "HTTP://h/"]
    base = urls.Base.of(F.lit("http://b/c/d"))
    found = column(spark, links, lambda v: F.when(urls.plain(v), urls.resolve_plain(v, base)))
    assert [v for v, f in zip(links, found) if f] == ["/a?b=1", "http://h/x", "https://h", "/"]
    whole = column(spark, links, lambda v: urls.resolve(v, base))
    assert all(f is None or f == w for f, w in zip(found, whole))


def test_urls_in_text_are_found_as_in_the_whole_text(spark):
    rng = random.Random(3)
    parts = ["http://", "ftp://", "xhttps://", "://", "h", "a.b", "/", "?q", "#f", " ", "\n", "'", '"', "u:p@", ":80", "é", "[::1]"]
    texts = ["".join(rng.choice(parts) for _ in range(30)) for _ in range(300)]
    whole = lambda v: F.array_distinct(F.regexp_extract_all(v, F.lit(fixed.URL_PATTERN), F.lit(0)))
    assert column(spark, texts, text.urls_in_text) == column(spark, texts, whole)
