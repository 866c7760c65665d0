"""Pages to labelled links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import fixed
from linkloom.functions import html as H
from linkloom.functions import nesting as N
from linkloom.functions import text as T
from linkloom.functions.binding import let
from linkloom.functions.entities import decode_entities
from linkloom.functions.urls import Base, absolute_url, parses, plain, resolve, resolve_plain, resolves, trim_link
from linkloom.operators import rules as R
from linkloom.operators.filters import keyword_predicate


_TEXT_SCOPES = {"node": (H.node_texts,), "document": (H.document_text,), "both": (H.node_texts, H.document_text)}


def _with_page_text(staged: DataFrame, text_scope: str) -> tuple[DataFrame, Column]:
    """URLs in the text of a page: of each text node, and of all nodes together. For the
    text of each element see ``_element_text_urls``.

    Decoded text and the texts made from it are columns of their own stages, as each is used more than once."""
    if text_scope not in _TEXT_SCOPES:
        raise ValueError(f"text_scope must be one of {sorted([*_TEXT_SCOPES, 'element'])}, not {text_scope!r}")
    marked, decoded = F.col("marked"), F.col("decoded")
    staged = staged.withColumn("decoded", F.when(H.may_hold_url(marked), H.decode_marked(marked)))
    texts = {f"text_{n}": scope(decoded) for n, scope in enumerate(_TEXT_SCOPES[text_scope])}
    first, *others = [T.urls_in_text(F.col(name)) for name in texts]
    for other in others:
        first = F.array_union(first, other)
    return staged.withColumns(texts), F.when(decoded.isNotNull(), first)


def _element_text_urls(texts: Column, intervals: Column) -> Column:
    """URLs in the text of every element, descendants included."""
    # the root holds all of it, whether or not the page has a tag for it
    root = T.urls_in_text(F.array_join(texts, ""))
    return F.when(intervals.isNotNull(), F.array_union(N.found_in_elements(texts, intervals, T.urls_in_text), root))


def _first_base_href(tokens: Column) -> Column:
    """``href`` of the first ``<base>`` that has one."""
    hrefs = F.transform(
        F.filter(tokens, lambda t: t.rlike(r"(?i)\A<base[\t\n\f\r /]")),
        lambda t: H.attributes(t)["href"],
    )
    return F.get(F.array_compact(hrefs), F.lit(0))


def _row(rule: R.LinkRule, e: R.Element, raw: Column) -> Column:
    return F.struct(
        rule.label_column(e).alias("source"),
        raw.alias("raw"),
        F.lit(rule.follow).alias("follow"),
        F.lit(rule.inside).alias("inside"),
    )


def _element_links(rules: Sequence[R.LinkRule], e: R.Element) -> Column:
    """Links of one element: an array with a NULL for every rule that gives none.

    For rules with one link each there is no lambda in it, so Spark compiles it.
    """
    one = F.array(F.lit(None).cast(_LINK), *[F.when(r.when(e), _row(r, e, r.value(e))) for r in rules if not r.many])
    many = [r for r in rules if r.many]
    if not many:
        return one

    def rows(rule: R.LinkRule) -> Column:
        found = F.when(rule.when(e), F.transform(rule.value(e), lambda raw: _row(rule, e, raw)))
        return F.coalesce(found, F.array().cast(f"array<{_LINK}>"))

    return F.concat(one, *[rows(r) for r in many])


def _script_links(rules: Sequence[R.LinkRule], tokens: Column) -> Column:
    """Links in script bodies, as marked strings. Scripts are few, and those that
    name a scheme fewer."""

    def links_of(token: Column) -> Column:
        return let(H.raw_body(token), lambda body: found_in(R.Element(F.lit("script"), body, H.attributes(token))))

    def found_in(e: R.Element) -> Column:
        return F.concat(*[
            F.transform(
                F.coalesce(F.when(r.when(e), r.value(e)), F.array().cast("array<string>")),
                lambda url: F.concat(F.lit(f"{_FOUND}{r.label}{_FOUND}"), url),
            )
            for r in rules
        ])

    scripts = F.filter(tokens, lambda t: t.contains("://") & t.rlike(_SCRIPT))
    return F.flatten(F.transform(scripts, links_of))


_LINK = "struct<source:string,raw:string,follow:boolean,inside:boolean>"
# Begins a link found on the page as a whole, among the tokens: mark, label, mark, URL.
_FOUND = "\x01"
_SCRIPT = r"(?i)\A<script[\t\n\f\r />]"


def _found(label: str, urls: Column) -> Column:
    """Links found on the page as a whole, as marked strings."""
    prefix = F.lit(f"{_FOUND}{label}{_FOUND}")
    return F.transform(urls, lambda u: F.concat(prefix, u))


def raw_links(
    pages: DataFrame,
    rules: Sequence[R.LinkRule],
    *,
    page_text: bool = False,
    text_scope: str = "both",
    honor_base: bool = True,
    raw_tags: tuple[str, ...] = fixed.RAW_TEXT_TAGS,
    keep: Sequence[str] = (),
    in_page: dict[str, Column] | None = None,
) -> DataFrame:
    """Unresolved links: ``(where_url, base, source, raw, follow, inside)``.

    ``in_page`` has arrays made from ``html`` as a whole, by label.

    One narrow pass: scan, cut each page into tokens, drop tokens that cannot
    hold a link, apply all rules to each, explode. Nothing is shuffled. The outer
    forms of the generators are meant: for the others the optimizer adds a test
    for "not empty" below, which would run the expressions on each page twice.
    """
    html, token = F.col("html"), F.col("token")
    with_text = any(r.element_text for r in rules)
    by_element = page_text and text_scope == "element"
    in_scripts = [r for r in rules if r.scripts_only]
    # every value that is used more than once is a column of its own stage
    columns = [H.tokens(html, raw_tags, with_text=False).alias("tokens")]
    if page_text and not by_element:
        columns.append(H.marked_text(html, raw_tags).alias("marked"))
    staged = pages.select("url", *keep, "html", *columns).withColumn("tokens", H.complete(F.col("tokens")))
    items = [F.col("tokens")]
    if with_text or by_element:
        asking = [r for r in rules if r.element_text]
        staged = _nested(staged, raw_tags, asking, by_element)
        parsed, texts, intervals = F.col("parsed"), F.col("texts"), F.col("intervals")
        if with_text:
            whole = N.elements_with_text(parsed, texts, intervals, lambda piece, text: _text_asked(asking, piece, text))
            items = [F.coalesce(whole, F.col("tokens"))]
        if by_element:
            items.append(_found(R.PAGE_TEXT, _element_text_urls(texts, intervals)))
    if in_scripts:
        items.append(_script_links(in_scripts, F.col("tokens")))
    if page_text and not by_element:
        staged, urls = _with_page_text(staged, text_scope)
        items.append(_found(R.PAGE_TEXT, urls))
    for label, found in (in_page or {}).items():
        items.append(_found(label, found))
    none = F.array().cast("array<string>")
    item = F.concat(*[F.coalesce(i, none) for i in items]).alias("items")
    if honor_base:
        named = F.when(html.rlike(r"(?i)<base[\t\n\f\r /]"), _first_base_href(F.col("tokens")))
        staged = staged.select("url", *keep, item, named.alias("base_href"))
        base_url = F.when(F.col("base_href").isNull(), F.col("url")).otherwise(
            absolute_url(F.col("base_href"), F.col("url"))
        )
        staged = staged.select("url", *keep, "items", F.coalesce(base_url, F.col("url")).alias("base_url"))
    else:
        staged = staged.select("url", *keep, item, F.col("url").alias("base_url"))
    per_token = (
        staged.select("url", *keep, "items", Base.of(F.col("base_url")).to_struct().alias("base"))
        .select("url", *keep, "base", F.explode_outer("items").alias("token"))
        # for most rules bare tags hold no links, and this test is cheaper than parsing
        .where(token.rlike(_MAY_LINK if all(id(r) in R.BUILT_IN and not r.bare for r in rules) else _ANY_TAG))
    )
    e = R.Element(F.col("tag"), F.coalesce(F.col("text"), F.lit("")))
    links = _element_links([r for r in rules if not r.scripts_only], e)
    on_page = F.when(
        token.startswith(_FOUND),
        let(
            F.split(token, _FOUND, 3),
            lambda p: F.array(
                F.struct(
                    p[1].alias("source"), p[2].alias("raw"), F.lit(False).alias("follow"), F.lit(False).alias("inside")
                )
            ),
        ),
    )
    links = F.coalesce(on_page, links).alias("links")
    parsed = _parsed(per_token, e, rules, raw_tags, with_text, ["url", *keep, "base", "token"])
    # The rules are a column of their own, not an argument of the generator. With
    # the lambda above in it, Spark compiles that projection into many small
    # methods; as part of one whole-stage method, some dozen rules pass the size
    # up to which the JVM compiles to machine code, and run many times slower.
    return (
        parsed.select(F.col("url").alias("where_url"), *keep, "base", links)
        .select("where_url", *keep, "base", F.inline_outer("links"))
        .where(F.col("raw").isNotNull())
    )


def _any(tests: Sequence[Column]) -> Column:
    first, *others = tests
    for other in others:
        first = first | other
    return first


def _nested(staged: DataFrame, raw_tags: tuple[str, ...], rules: Sequence[R.LinkRule], by_element: bool) -> DataFrame:
    """With the pieces of a page, their texts, and the intervals of its elements among them.

    NULL on pages where no rule needs the text of an element.
    """
    html, texts = F.col("html"), F.col("texts")
    in_tag = F.lit(True) if by_element else _any([html.contains(r.text_in_tag) if r.text_in_tag else F.lit(True) for r in rules])
    if "marked" in staged.columns and all(r.text_holds_url for r in rules):
        in_tag = in_tag & H.may_hold_url(F.col("marked"))
    holds_url = F.array_join(texts, "").contains("://")
    needed = [holds_url if r.text_holds_url else F.lit(True) for r in rules] + ([holds_url] if by_element else [])
    pieces = N.parsed_pieces(H.pieces(N.without_marks(html), raw_tags), raw_tags)
    parsed = staged.withColumn("parsed", F.when(in_tag, pieces)).withColumn("texts", N.piece_texts(F.col("parsed")))
    return parsed.withColumn("intervals", F.when(_any(needed), N.intervals(F.col("parsed"))))


def _text_asked(rules: Sequence[R.LinkRule], piece: Column, text: Column) -> Column:
    """True for elements whose text some rule looks at."""
    return _any([
        (piece.contains(r.text_in_tag) if r.text_in_tag else F.lit(True)) & (text.contains("://") if r.text_holds_url else F.lit(True))
        for r in rules
    ])


def _parsed(
    per_token: DataFrame, e: R.Element, rules: Sequence[R.LinkRule], raw_tags: tuple[str, ...], with_text: bool,
    kept: list[str],
) -> DataFrame:
    """Tokens with the tag, the text, and the attributes the rules ask for.

    An attribute is cut out by one compiled expression, on tags that hold its name at all; its value
    is a stage of its own, as it looks at what was cut out several times. The map of all attributes is made
    only for rules that ask for it. The lambda that decodes character references stands next to the
    others on purpose: see the end of ``raw_links``.
    """
    token, tag, low = F.col("token"), F.col("tag"), F.col("low")
    text = F.try_element_at(F.split(token, N.MARK, 2), F.lit(2)) if with_text else F.lit(None).cast("string")
    scoped = all(id(r) in R.BUILT_IN for r in rules)
    anywhere = {name for r in rules for name in r.anywhere}
    found, values = {}, {}
    for name in e.asked:
        tags = R.ATTRIBUTE_TAGS.get(name) if scoped and name not in anywhere else None
        holds = low.contains(name) & tag.isin(*tags) if tags else low.contains(name)
        cut = e.column(name)
        found[cut] = F.when(holds, H.attribute_as_written(token, name)).otherwise("")
        value = H.value_as_written(F.col(cut))
        values[cut] = F.when(F.col(cut).contains("&"), decode_entities(value, in_attribute=True)).otherwise(value)
    attrs = H.attributes(token) if e.asked_all else F.lit(None).cast("map<string,string>")
    return (
        per_token.withColumns({"tag": H.tag_name(token), "low": F.lower(token)})
        .select(*kept, "tag", text.alias("text"), *[column.alias(cut) for cut, column in found.items()])
        .select(*kept, "tag", "text", attrs.alias("attrs"), *[column.alias(cut) for cut, column in values.items()])
    )


# A link found on the page, or a tag that has an attribute.
_MAY_LINK = rf"\A(?:{_FOUND}|<[A-Za-z][^\t\n\f\r />]*+[\t\n\f\r /]++[^\t\n\f\r />])"
# The same with tags that have none.
_ANY_TAG = rf"\A(?:{_FOUND}|<[A-Za-z])"


def extract_links(
    pages: DataFrame,
    profile: str = "full",
    *,
    rules: Sequence[R.LinkRule] = (),
    keywords: Sequence[str] | None = None,
    data_labels: bool = False,
    honor_base: bool = True,
    encode: str = "none",
    keep_fragment: bool = False,
    text_scope: str = "both",
    urls_only: bool = False,
    size_kb: int = -1,
    lineage: bool = False,
    distinct: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Labelled absolute links of ``pages(url, html)``: ``(source, url, where_url)``.

    ``profile`` is ``core``, ``full``, ``exclusive`` or ``grouped``, or ``py`` for the links of
    ``plain_links``, which takes ``keywords``, ``size_kb`` and ``distinct`` of the options; ``rules`` adds
    rules of your own. ``keywords`` keeps links whose raw form contains one of
    them. ``urls_only`` drops page metadata that is no URL. ``lineage`` adds
    ``raw``, ``follow`` and ``inside``; ``keep`` carries columns of ``pages`` over.
    """
    if profile == "py":
        if rules or data_labels or keep or lineage:
            raise ValueError("the py profile takes no rules, labels, lineage or kept columns")
        cut = pages.withColumn("html", T.truncate_body(F.col("html"), size_kb)) if size_kb >= 0 else pages
        found = plain_links(cut, keywords=keywords)
        return found.distinct() if distinct else found
    chosen = (*R.PROFILES[profile], *rules)
    if data_labels:
        chosen = (*chosen, R.DATA, R.CUSTOM_DATA)
    return links_by_rules(
        pages,
        chosen,
        page_text=True,
        keywords=keywords,
        honor_base=honor_base,
        encode=encode,
        keep_fragment=keep_fragment,
        text_scope=text_scope,
        urls_only=urls_only,
        size_kb=size_kb,
        lineage=lineage,
        distinct=distinct,
        keep=keep,
    )


def links_by_rules(
    pages: DataFrame,
    rules: Sequence[R.LinkRule],
    *,
    page_text: bool = False,
    keywords: Sequence[str] | None = None,
    honor_base: bool = True,
    encode: str = "none",
    keep_fragment: bool = False,
    text_scope: str = "both",
    urls_only: bool = False,
    size_kb: int = -1,
    lineage: bool = False,
    distinct: bool = True,
    keep: Sequence[str] = (),
    raw_tags: tuple[str, ...] = fixed.RAW_TEXT_TAGS,
) -> DataFrame:
    """``extract_links`` for any set of rules."""
    if size_kb >= 0:
        pages = pages.withColumn("html", T.truncate_body(F.col("html"), size_kb))
    links = raw_links(
        pages, rules, page_text=page_text, text_scope=text_scope,
        honor_base=honor_base, raw_tags=raw_tags, keep=keep,
    )
    if keywords:
        links = links.where(keyword_predicate(F.col("raw"), keywords))
    if urls_only:
        links = links.where((F.col("source") != "meta") | F.col("raw").rlike(_LOOKS_LIKE_URL))
    base, link = Base.from_struct("base"), F.col("link")
    columns = ["source", "url", "where_url", *keep] + (["raw", "follow", "inside"] if lineage else [])
    usual = F.col("usual")
    url = F.when(usual, resolve_plain(link, base)).otherwise(resolve(link, base, keep_fragment, encode))
    kept = usual | resolves(link, base, keep_fragment) & parses(link)
    out = _resolved(links, kept, url).select(*columns)
    return out.distinct() if distinct else out


def _resolved(links: DataFrame, kept: Column, url: Column) -> DataFrame:
    """``kept`` links with ``url``; both see links trimmed as ``link``, and as ``usual`` those that are plain.

    They go through a generator: a test on them would be moved below by the optimizer, and
    run a second time what it looks at. What it takes apart is a column of its own, as Spark does not
    compile the argument of a generator that has lambdas in it. A page without a URL has links without one.
    """
    staged = links.withColumn("usual", plain(F.col("raw"))).withColumn(
        "link", F.when(F.col("usual"), F.col("raw")).otherwise(trim_link(F.col("raw")))
    )
    staged = staged.withColumn("founds", F.array(F.when(kept, F.struct(url.alias("url")))))
    found = F.explode_outer("founds").alias("found")
    return staged.select("*", found).where(F.col("found").isNotNull()).withColumn("url", F.col("found.url"))


_LOOKS_LIKE_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|/|\.\.?/|\?)"


def link_label(pages: DataFrame, label: str, **options) -> DataFrame:
    """Links of one label."""
    if label == R.PAGE_TEXT:
        return links_by_rules(pages, (), page_text=True, **options)
    return links_by_rules(pages, R.by_label(label), **options)


def plain_links(pages: DataFrame, depths: int | None = None, keywords: Sequence[str] | None = None) -> DataFrame:
    """Everything the plain profile finds, as a bag: ``(source, url, where_url)``.

    ``keywords`` keeps links whose raw form contains one of them.

    Repeats are kept. With ``depths`` each row comes once per depth 0..depths and
    carries it, the way a run that writes one file per depth has it.
    """
    html = F.col("html")
    found = raw_links(
        pages, R.PLAIN, honor_base=False, raw_tags=fixed.RAW_TEXT_TAGS_PLAIN,
        in_page={"css_url": T.css_urls(html), "origin": T.origins_in_text(html), "http_run": T.http_urls_in_text(html)},
    )
    if keywords:
        found = found.where(keyword_predicate(F.col("raw"), keywords))
    base, link = Base.from_struct("base"), F.col("link")
    as_written = F.col("source").isin(R.PLAIN_THIRD_PARTY.label, "origin", "http_run")
    usual = F.col("usual")
    resolved = F.when(usual, resolve_plain(link, base)).otherwise(resolve(link, base, keep_fragment=True, lenient=True))
    links = (
        found.withColumn("usual", plain(F.col("raw")))
        .withColumn("link", F.when(usual, F.col("raw")).otherwise(trim_link(F.col("raw"))))
        .where(as_written | usual | resolves(link, base, keep_fragment=True))
        .withColumn("url", F.when(as_written, F.col("raw")).otherwise(resolved))
        .select("source", "url", "where_url")
    )
    if depths is None:
        return links
    return links.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depths))))


def plain_unresolved(pages: DataFrame) -> DataFrame:
    """Script addresses that name a web scheme, as written."""
    return raw_links(
        pages, (R.PLAIN_THIRD_PARTY,), honor_base=False, raw_tags=fixed.RAW_TEXT_TAGS_PLAIN
    ).select("source", F.col("raw").alias("url"), "where_url")
