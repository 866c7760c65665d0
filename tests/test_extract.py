"""Tokenizer and link rules."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from linkloom import fixed
from linkloom.functions import html as H
from linkloom.functions import nesting as N
from linkloom.operators import rules as R
from linkloom.operators.elements import html_elements
from linkloom.operators.extract import extract_links, link_label, links_by_rules, plain_links

ADVERSARIAL = [
    "<a href=/bare>x</a><A HREF='single'>y</A><a href = \"spaced\" >z</a>",
    "<!-- <a href=no> --><a href=yes><!----><b x><!-- <i y>--> <u z>",
    "<script>var a='<a href=no>'; if (a<b) c();</script><p q=1>",
    "<a title=\"a>b\" href=\"/q?x=1&amp;y=2\">",
    "<a href=1 HREF=2 href=3><br/><img src=x/ alt=''/>",
    "<p><b>unclosed<br><p>",
    "text only",
    "<style>a > b {}</style><div data-x>",
    "<a\nhref\n=\n'multi\nline'\t>",
    "<a href='é&eacute;&#233;'>",
    "</a href=no><a/href=slash>",
]


class Tags(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        first = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        self.found.append((tag, first))

    handle_startendtag = handle_starttag


def pages(spark, *htmls):
    return spark.createDataFrame([(f"http://h/{i}", h) for i, h in enumerate(htmls)], "url string, html string")


def links(df):
    return {(r["source"], r["url"]) for r in df.collect()}


def test_elements_against_standard_parser(spark):
    rows = html_elements(pages(spark, *ADVERSARIAL)).orderBy("url", "ord").collect()
    for i, source in enumerate(ADVERSARIAL):
        parser = Tags()
        parser.feed(source)
        parser.close()
        assert [(r["tag"], r["attrs"]) for r in rows if r["url"] == f"http://h/{i}"] == parser.found, source


def test_single_attributes_agree_with_the_map(spark):
    names = ["href", "title", "x", "y", "alt", "src", "q", "slash", "data-x", "hre"]
    token = F.col("token")
    df = pages(spark, *ADVERSARIAL).select(F.explode_outer(H.tokens(F.col("html"))).alias("token"))
    df = df.where(H.is_start_tag(token) & ~token.contains("&"))
    pairs = [(H.attribute(token, n), H.attributes(token)[n]) for n in names]
    same = [F.coalesce(one.eqNullSafe(other), F.lit(False)) for one, other in pairs]
    rows = df.select(token, *[s.alias(n) for s, n in zip(same, names)]).collect()
    assert len(rows) > 15
    for row in rows:
        assert all(row[n] for n in names), row


def test_abruptly_closed_comments(spark):
    """By the standard ``<!-->`` and ``<!--->`` are whole comments, and ``--!>``
    closes one; the library parser above goes by older rules."""
    got = html_elements(pages(spark, "<!--><a x><!---><b y>--><!-- -- > <i z> --!><u>"))
    assert [r["tag"] for r in got.orderBy("ord").collect()] == ["a", "b", "u"]


def test_elements_of_broken_pages(spark):
    got = html_elements(pages(
        spark, None, "", "<!-- never closed <a href=x>", "<script>never closed <a href=x>",
        "<a href=x><b title=\"never closed>", "<noscript><a href=x></noscript><textarea><a href=y></textarea>",
    ))
    tags = [(r["url"], r["tag"]) for r in got.orderBy("url", "ord").collect()]
    assert tags == [("http://h/3", "script"), ("http://h/4", "a"), ("http://h/5", "noscript"), ("http://h/5", "textarea")]
    plain = html_elements(pages(spark, "<noscript><a href=x></noscript>"), fixed.RAW_TEXT_TAGS_PLAIN)
    assert [r["tag"] for r in plain.orderBy("ord").collect()] == ["noscript", "a"]


def test_large_markup(spark):
    many = "<a " + " ".join(f"x{i}='{i}'" for i in range(5000)) + " href=/end>"
    big = "<script>" + "x<y;" * 500_000 + "</script><a href=/after>"
    quotes = "<a \"" * 20_000
    got = html_elements(pages(spark, many, big, quotes)).where("tag = 'a'").select(F.col("attrs")["href"])
    assert sorted(r[0] for r in got.collect() if r[0]) == ["/after", "/end"]


def test_anchor_forms(spark):
    html = "<a href=''>1</a><a href>2</a><a href='#f'>3</a><a href='mailto:x'>4</a><a href=' s '>5</a><a name=n>6</a>"
    assert links(link_label(pages(spark, html), "href")) == {
        ("href", "http://h/0"), ("href", "mailto:x"), ("href", "http://h/s"),
    }


def test_text_urls_by_node_and_document(spark):
    html = "<p><b>http://a/x</b>y <i>http:</i>//b/z</p><script>'http://c/&amp;'</script>&#104;ttp://d/"

    def found(scope):
        return {u for s, u in links(extract_links(pages(spark, html), "core", text_scope=scope)) if s == R.PAGE_TEXT}

    assert found("node") == {"http://a/x", "http://c/&amp;", "http://d/"}
    assert found("document") == {"http://a/xy", "http://b/z", "http://c/&amp;", "http://d/"}
    assert found("both") == found("node") | found("document")


def test_base_href(spark):
    html = "<base target=x><base href='b/'><base href='/late/'><a href=y>"
    assert links(link_label(pages(spark, html), "href")) >= {("href", "http://h/b/y")}
    assert ("href", "http://h/y") in links(link_label(pages(spark, html), "href", honor_base=False))


def test_exclusive_and_grouped(spark):
    html = "<link rel=manifest href=m><script src=ws://s></script><a href=x.xml src=z></a><img src=i.webp><video src=v>"
    assert links(extract_links(pages(spark, html), "exclusive")) == {
        ("manifest", "http://h/m"), ("script", "ws://s"), ("href", "http://h/x.xml"),
        ("webp-image", "http://h/i.webp"), ("embedded", "http://h/v"),
    }
    grouped = links(extract_links(pages(spark, html), "grouped"))
    assert ("manifest", "http://h/m") not in grouped
    assert {("form", "http://h/0"), ("script", "http://h/z"), ("video", "http://h/v"), ("websocket", "ws://s")} <= grouped


def test_rules_on_bare_tags(spark):
    df = pages(spark, "<script>1</script><b>/bold</b>")
    assert links(extract_links(df, "grouped")) >= {("href", "http://h/0"), ("script", "http://h/0")}
    bold = R.LinkRule("bold", lambda e: e.is_("b"), lambda e: e.text, element_text=True)
    assert ("bold", "http://h/bold") in links(extract_links(df, "core", rules=[bold]))


def test_own_rules_options_and_kept_columns(spark):
    df = pages(spark, "<a data-go='/x' href=/y></a><meta content='no url'><meta content='/m'>").withColumn("day", F.lit(7))
    rule = R.LinkRule("go", lambda e: e.has("data-go"), lambda e: e.attr("data-go"))
    got = extract_links(df, "core", rules=[rule], keep=["day"], lineage=True)
    assert ("go", "/x", 7) in {(r["source"], r["raw"], r["day"]) for r in got.collect()}
    full = links(extract_links(df, "full", urls_only=True))
    assert ("meta", "http://h/m") in full and ("meta", "http://h/no url") not in full
    assert ("meta", "http://h/no url") in links(extract_links(df, "full"))
    assert links(extract_links(df, "core", size_kb=0)) == set()
    assert links(extract_links(df, "core", keywords=["zzz"])) == set()
    assert links(extract_links(df, "core", keywords=["zzz", ""])) == links(extract_links(df, "core"))
    with pytest.raises(ValueError):
        extract_links(df, text_scope="other")
    with pytest.raises(KeyError):
        R.by_label("other")


def test_split_and_order_do_not_matter(spark, sf_dir):
    from linkloom.plans.corpora import captured_pages

    df = captured_pages(spark, sf_dir)
    whole = set(extract_links(df, "full").collect())
    assert set(extract_links(df.repartition(7), "full").collect()) == whole
    halves = [df.where(F.length("url") % 2 == i) for i in range(2)]
    assert set().union(*[extract_links(h, "full").collect() for h in halves]) == whole


def test_plain_links_are_a_bag(spark):
    html = "<a href=x><a href=x><link rel='x stylesheet' href=s.css><script src=https://o/l.js></script>"
    rows = sorted((r["source"], r["url"]) for r in plain_links(pages(spark, html)).collect())
    assert rows == [
        ("http_run", "https://o/l.js></script>"), ("py_href", "http://h/s.css"), ("py_href", "http://h/x"),
        ("py_href", "http://h/x"), ("py_script", "https://o/l.js"), ("py_style", "http://h/s.css"),
        ("py_third_party", "https://o/l.js"),
    ]
    assert plain_links(pages(spark, html), depths=2).count() == 3 * len(rows)


def test_extraction_reads_two_columns_and_shuffles_once(spark, sf_dir):
    df = extract_links(spark.read.parquet(f"{sf_dir}/pages.parquet"), "full")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string,html:string>" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    # the optimizer must not run the tokenizer twice to test for emptiness
    narrow = links_by_rules(spark.read.parquet(f"{sf_dir}/pages.parquet"), R.CORE, distinct=False)
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "size(regexp_extract_all" not in plan and "Python" not in plan


def test_own_rules_with_any_attribute_name(spark):
    html = "<b (click)='/c1' data.href=/c2 xlink:href=/c3><b (Click)='/c4&amp;'><b clickx=/no>"
    for name, want in (("(click)", {"/c1", "/c4&"}), ("data.href", {"/c2"}), ("xlink:HREF", {"/c3"})):
        rule = R.LinkRule("own", lambda e, n=name: e.has(n), lambda e, n=name: e.attr(n))
        assert links(links_by_rules(pages(spark, html), (rule,))) == {("own", f"http://h{u}") for u in want}


def test_grouped_label_and_value_go_together(spark):
    html = "<a href=/x src='data:image/gif,AA'><a href=/z.xml><iframe><script>'http://j/1'</script>"
    got = links(extract_links(pages(spark, html), "grouped"))
    assert {v for k, v in got if k in ("data-uri", "websocket", "sitemap")} == {"data:image/gif,AA", "http://h/z.xml"}
    # tags without attributes give the page itself, scripts their text
    assert ("script", "http://h/0") in got and ("jscode", "http://j/1") in got


def test_links_with_a_scheme_lose_dot_segments(spark):
    html = "<a href='http://h/a/../3?x=/../y'><a href=//g/b/./c/..><a href='mailto:a/../b'><a href='http://h/a..b/c.'>"
    assert {u for _, u in links(link_label(pages(spark, html), "href"))} == {
        "http://h/3?x=/../y", "http://g/b/", "mailto:a/../b", "http://h/a..b/c.",
    }
    plain = {u for s, u in links(plain_links(pages(spark, html))) if s == "py_href"}
    assert plain >= {"http://h/a/../3?x=/../y", "http://g/b/./c/.."}


def test_references_that_do_not_parse_give_nothing(spark):
    html = "<a href='http://h/%zz'><a href='/50%'><a href='http://a b/c'><a href='/ok%41?100%'><a href='mailto:100%'><a href='/x#%q'>"
    assert {u for _, u in links(link_label(pages(spark, html), "href"))} == {"http://h/ok%41?100%", "mailto:100%"}


def test_plain_profile_scans_once(spark, sf_dir):
    df = plain_links(spark.read.parquet(f"{sf_dir}/pages.parquet"), depths=2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan


class Nested(HTMLParser):
    """Elements with their whole text, by a stack."""

    def __init__(self):
        super().__init__()
        self.open, self.done = [], []

    def _last(self, names):
        return max((i + 1 for i, e in enumerate(self.open) if e[0] in names), default=0)

    def handle_starttag(self, tag, attrs):
        if tag not in fixed.VOID_TAGS:
            for tags, ended, behind in fixed.IMPLIED_ENDS:
                if tag in tags and self._last(ended) > self._last(behind):
                    self.open = self.open[: self._last(ended) - 1]
        self.done.append([tag, ""])
        if tag not in fixed.VOID_TAGS:
            self.open.append(self.done[-1])

    def handle_endtag(self, tag):
        if self._last([tag]):
            self.open = self.open[: self._last([tag]) - 1]

    def handle_data(self, data):
        for e in self.open:
            e[1] += data


def nested(df, raw=("script",)):
    parsed = df.withColumn("parsed", N.parsed_pieces(H.pieces(F.col("html"), raw), raw))
    parsed = parsed.withColumn("texts", N.piece_texts(F.col("parsed"))).withColumn("found", N.intervals(F.col("parsed")))
    items = N.elements_with_text(F.col("parsed"), F.col("texts"), F.col("found"), lambda piece, text: F.lit(True))
    return parsed.select("url", items.alias("items"))


def test_element_text_against_a_stack(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 8)
    rng = random.Random(5)
    tags = ["p", "b", "span", "div", "li", "ul", "td", "tr", "table", "br", "img", "option", "select", "dd", "dl"]
    kinds = (
        lambda: f"<{rng.choice(tags)}{rng.choice(['', ' data-x=1'])}>", lambda: f"</{rng.choice(tags)}>",
        lambda: rng.choice(["<script>x<b>'http://s/1'</script>", "<!-- <p> -->"]),
        lambda: rng.choice(["http://a/", "1", "2 ", "&amp;", "ftp:", "//b/", "é"]),
    )
    sources = ["".join(rng.choice(kinds)() for _ in range(rng.randint(0, 40))) for _ in range(150)]
    for row in nested(pages(spark, *sources)).collect():
        source = sources[int(row["url"].rsplit("/", 1)[1])]
        parser = Nested()
        parser.feed(source)
        parser.close()
        got = [(H.re.match("<([a-z]+)", i)[1], i.split(N.MARK)[1]) for i in row["items"] or []]
        assert sorted(got) == sorted((tag, text) for tag, text in parser.done), source


def test_text_urls_by_element(spark):
    html = "<p>x <span><b>http://a/1</b>2</span>3</p><p>f<b>tp://c/1</b></p><i>ht<b>tp://</b>b/</i><script>'http://j/'</script>"
    found = {u for s, u in links(extract_links(pages(spark, html), "core", text_scope="element")) if s == R.PAGE_TEXT}
    assert found >= {"http://a/1", "http://a/12", "http://a/123", "ftp://c/1", "http://b/", "http://j/"}
    assert links(extract_links(pages(spark, None, "", "no url"), "core", text_scope="element")) == set()


def test_whole_text_of_data_elements(spark):
    html = "<div data-x=1><b>/d/1</b></div><i data-custom-y>/d/<u>2</u></i><div data-z></div><b data-n=1>/d/3\x02<p>"
    got = links(extract_links(pages(spark, html), "core", data_labels=True))
    assert {v for k, v in got if k == "data"} == {"http://h/d/1", "http://h/d/2", "http://h/d/3"}
    assert {v for k, v in got if k == "custom-data"} == {"http://h/d/2"}
    grouped = links(extract_links(pages(spark, "<a href=/x>go <b>http://t/1</b></a>"), "grouped"))
    assert ("jscode", "http://t/1") in grouped


def test_element_text_of_a_large_page(spark):
    """The cost grows with the page and not with its square."""
    html = "<div>" * 3 + "<p data-x=1>http://u/1 <b>x</b></p>" * 20_000
    got = links(extract_links(pages(spark, html), "core", text_scope="element", data_labels=True))
    assert ("custom_REGEX", "http://u/1") in got and len(got) == 2


def test_links_are_tested_once_and_pages_without_a_url_keep_theirs(spark):
    from linkloom.functions import urls as U

    pages = spark.createDataFrame(
        [(None, '<a href="/x">1</a>'), ("http://h/d/", '<a href="/y&amp;z">1</a><a HREF="%">2</a><p>&#104;ttp://n/1</p>')],
        "url string, html string",
    )
    links = extract_links(pages, "core", distinct=False)
    assert {(r.source, r.url) for r in links.collect()} == {("href", None), ("href", "http://h/y&z"), ("custom_REGEX", "http://n/1")}
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(U._PLAIN) == 1


def test_resolving_is_no_argument_of_a_generator(spark):
    rows = [("http://h/a/", '<a href="b">1</a><a href="../c?x=1 2">2</a><img src="//i/j.png">')]
    pages = spark.createDataFrame(rows, "url string, html string")
    links = extract_links(pages, "core", distinct=False)
    plan = links._jdf.queryExecution().executedPlan().toString()
    # Spark does not compile the argument of a generator with lambdas in it
    assert not re.search(r"explode\((?!\w+#\d+\))", plan)
    assert {r["url"] for r in links.collect()} >= {"http://h/a/b", "http://i/j.png"}
