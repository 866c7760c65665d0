"""Main text of web pages by wrapper induction.

A page becomes a tree of slots: elements with the same tag and class under the same
parent share one slot, so a list of paragraphs is one slot however long it is. The
wrapper of a host is the merged tree of all its pages. Slots have unlike labels where they
have one parent, so the largest matching of a page with the merged tree, whatever the
order of siblings, is the one by paths of labels: a slot is named by a hash of its path,
and no tree has to be carried. Over all pages of a host the texts of each slot are
counted, whole and node by node. A slot that has the same text in nearly all of at least
``MIN_PAGES`` different pages that have it is template; so is a node's text in a slot
that varies, if nearly all of these pages have it there. The rest is content. What
remains is cut by what the markup says itself: menus,
page headers and footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments vary between pages too, but are not the article. Tags say it, and whole names in
class, id or role; names on the page's own elements, paragraphs and headings say nothing,
nor do those around a main element.

How it runs: pages stay where they are; the first pass sends narrow rows (slot and hash
of a text) to an aggregate with map-side reduction, so a host with
a third of all pages is no group in one task. Templates (one row per host) are
joined to the pages; Spark broadcasts them only below its own size limit, and adaptive
execution may split a hot host. The second pass writes the texts.

Defined results: null html is an empty page, with an empty text. White space inside a
block becomes one space; blocks are joined by one line break; character references are
decoded. A page whose host has too few different pages, or none that varies, is cut
by markup alone. Pages that repeat count once for the wrapper and are all
extracted. Null urls make up one host. An empty table gives an empty result. Elements
nested deeper than ``DEPTH`` are read as children of that depth.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import cut_lineage, ready_for_python

MIN_PAGES = 5
SAME_SHARE = 0.9
DEPTH = 60

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose content is text only, up to their end tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: Start tags that end an open paragraph.
CLOSES_P = BLOCKS - set("body caption head html legend option optgroup tbody td tfoot th thead title tr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot", "select"}
NEVER = RAW | set(
    "head nav footer aside form noscript template svg math object audio video canvas button select input menu dialog map".split()
)
#: Whole names in class, id or role of what is not the article.
BOILERPLATE = re.compile(
    r"(?:^|\s)(?:(?:site|page|main|post|left|right|top|bottom|cookie|reader)[_-]?)?(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|cookies?|consent|gdpr|notices?|alert|pop-?up|modal|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|comments?|comment-?list|disqus|reply|replies|respond|share|sharing|"
    r"social|related|recommended|newsletter|subscribe|footer|masthead|toolbar|widget|search|contentinfo|complementary|dialog)"
    r"(?:[_-](?:ads?|area|banner|bar|block|box|container|content|form|inner|links?|list|menu|nav|notice|outer|section|wrap|wrapper))*(?=$|\s)",
    re.I,
)
#: Elements that are the page or a piece of its text; their names do not say what they are.
UNNAMED = set("html body main article p h1 h2 h3 h4 h5 h6".split())


class Slot:
    """A node of the generalised tree: child slots by label, its texts, and the hash of its path of labels."""

    __slots__ = ("children", "texts", "number")

    def __init__(self, number: int):
        self.children, self.texts, self.number = {}, [], number

    def child(self, label: str) -> Slot:
        found = self.children.get(label)
        if found is None:
            found = self.children[label] = Slot(_hash(f"{self.number} {label}"))
        return found


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def parse(html: str | None) -> tuple[Slot, list[tuple[str, Slot, bool, bool]]]:
    """The slots of a page and its blocks: (text, slot, dropped by markup, inside an article)."""
    root = Slot(0)
    # (tag, slot, dropped by tag, dropped by name, in article)
    stack: list[tuple[str, Slot, bool, bool, bool]] = [("", root, False, False, False)]
    blocks: list[tuple[str, Slot, bool, bool]] = []
    held: list[str] = []
    owner = stack[0]

    def flush() -> None:
        nonlocal held
        text = " ".join("".join(held).split())
        held = []
        if text:
            owner[1].texts.append(text)
            blocks.append((text, owner[1], owner[2] or owner[3], owner[4]))

    def text_in(text: str) -> None:
        nonlocal owner
        if not text:
            return
        # a part of other standing (an advert inside a paragraph) is a block of its own
        if stack[-1][2:4] != owner[2:4]:
            flush()
        if not held:
            owner = stack[-1]
        held.append(unescape(text))

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return
            if stack[k][0] in ("table", "body", "article") and tag not in BLOCKS:
                return

    html = html or ""
    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            text_in(html[at:])
            break
        text_in(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            close(tag)
            continue
        if tag in BLOCKS or tag in NEVER:
            flush()
        if tag == "br":
            held.append(" ")
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SIBLINGS[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in HOLDERS:
                    break
        names = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m[3])} if "=" in m[3] else {}
        label = f"{tag}.{re.sub('[0-9]+', '', names['class'])}" if names.get("class") else tag
        _, parent, by_tag, named, inside = stack[-1]
        slot = parent.child(label)
        # names are a guess: a main element inside a named one is content all the same
        main = tag == "main" or names.get("role") == "main"
        by_name = not main and (named or tag not in UNNAMED and any(BOILERPLATE.search(v) for v in names.values()))
        by_tag = by_tag or tag in NEVER or (tag == "header" and not inside)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            if tag in ("title", "textarea"):
                slot.texts.append(" ".join(unescape(html[at : end.start() if end else size]).split()))
            at = end.end() if end else size
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in NEVER:
            continue
        inside = inside or main or tag == "article"
        entry = (tag, slot, by_tag, by_name, inside)
        if len(stack) > DEPTH:
            entry = (tag, stack[-1][1], by_tag, by_name, inside)
        stack.append(entry)
    flush()
    return root, blocks


def filled_slots(page: Slot) -> Iterator[Slot]:
    todo = [page]
    while todo:
        slot = todo.pop()
        if slot.texts:
            yield slot
        todo += slot.children.values()


def host_of_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, slots, texts): the slots of each host that are template, and hashes of slot and text that are in others."""
    ready_for_python(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    given = pages.select(host_of_url(F.col(url_col)).alias("host"), F.xxhash64(html).alias("page"), html.alias("html"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h in batch.column("html").to_pylist():
                found = []
                for s in filled_slots(parse(h)[0]):
                    found.append({"slot": s.number, "text": _hash("\n".join(s.texts)), "whole": True})
                    found += [{"slot": s.number, "text": t, "whole": False} for t in {_hash(t) for t in s.texts}]
                rows.append(found)
            kind = pa.list_(pa.struct([("slot", pa.int64()), ("text", pa.int64()), ("whole", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(rows, kind)], ["host", "page", "slots"])

    counted = cut_lineage(
        given.mapInArrow(texts, "host string, page long, slots array<struct<slot:long,text:long,whole:boolean>>")
        # pages that repeat count once
        .groupBy("host", "page").agg(F.first("slots").alias("slots"))
        .select("host", F.explode("slots").alias("s")).select("host", "s.slot", "s.text", "s.whole")
        .groupBy("host", "slot", "text", "whole").agg(F.count("*").alias("n"))
    )
    of_slot = cut_lineage(
        counted.where("whole").groupBy("host", "slot").agg(F.max("n").alias("most"), F.sum("n").alias("pages"))
        .withColumn("same", (F.col("pages") >= MIN_PAGES) & (F.col("most") >= F.col("pages") * SAME_SHARE))
    )
    varying = of_slot.where(~F.col("same")).select("host", "slot", "pages")
    parts = (
        counted.where(~F.col("whole") & (F.col("n") >= MIN_PAGES * SAME_SHARE)).join(varying, ["host", "slot"])
        .where((F.col("pages") >= MIN_PAGES) & (F.col("n") >= F.col("pages") * SAME_SHARE))
        .groupBy("host").agg(F.collect_list(F.struct("slot", "text")).alias("texts"))
    )
    slots = of_slot.groupBy("host").agg(F.collect_list(F.when(F.col("same"), F.col("slot"))).alias("slots"), F.max((~F.col("same")).cast("int")).alias("varies"))
    return cut_lineage(slots.where("varies = 1").join(parts, "host", "left").select("host", "slots", "texts"))


def main_text(html: str | None, slots: list[int] | None, texts: list[dict] | None) -> str:
    """The article of one page."""
    _, blocks = parse(html)
    fixed, fixed_texts = set(slots or ()), {(t["slot"], t["text"]) for t in texts or ()}
    held = {slot for slot, _ in fixed_texts}
    kept = [
        b for b in blocks
        if not b[2] and b[1].number not in fixed and not (b[1].number in held and (b[1].number, _hash(b[0])) in fixed_texts)
    ]
    article = [b for b in kept if b[3]]
    # an article element is the page's text only if it holds most of what is left
    if 2 * sum(len(b[0]) for b in article) < sum(len(b[0]) for b in kept):
        article = kept
    return "\n".join(b[0] for b in article)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    templates = induce(pages, url_col, html_col)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("html", "slots", "texts"))
            made = [main_text(*row) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    given = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of_url(F.col(url_col)).alias("h")
    )
    joined = given.join(templates, F.col("h") == F.col("host"), "left").select("page_id", "url", "html", "slots", "texts")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    return joined.mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
