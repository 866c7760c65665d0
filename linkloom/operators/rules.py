"""The label table: which element gives which link.

A rule is data. ``extract_links`` turns all rules of a profile into one array
per element, so a page is scanned once however many rules there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom import fixed
from linkloom.functions.text import urls_in_text


class Element:
    """Columns of one element, as rules see them.

    The element notes which attributes are asked for, so that only those are
    parsed.
    """

    def __init__(self, tag: Column, text: Column, attrs: Column | None = None):
        self.tag = tag
        self.text = text
        self._attrs = attrs
        self.asked: dict[str, Column] = {}
        self._columns: dict[str, str] = {}
        self.asked_all = False

    @property
    def attrs(self) -> Column:
        """All attributes, as a map."""
        self.asked_all = True
        return F.col("attrs") if self._attrs is None else self._attrs

    def is_(self, *names: str) -> Column:
        return self.tag == names[0] if len(names) == 1 else self.tag.isin(*names)

    def value(self, name: str) -> Column:
        """Attribute value, NULL when absent. Names may hold any characters and are met in lower case."""
        name = name.lower()
        if name not in self.asked:
            if self._attrs is None:
                self._columns[name] = f"attr_{len(self._columns)}"
                mapped = F.col("attrs")
                self.asked[name] = F.when(mapped.isNotNull(), mapped[name]).otherwise(F.col(self.column(name)))
            else:
                self.asked[name] = self._attrs[name]
        return self.asked[name]

    def column(self, name: str) -> str:
        """The column an asked attribute is parsed into; numbered, since a name may be anything."""
        return self._columns[name]

    def attr(self, name: str) -> Column:
        """Attribute value, empty when absent."""
        return F.coalesce(self.value(name), F.lit(""))

    def has(self, name: str) -> Column:
        return self.value(name).isNotNull()

    def has_prefix(self, prefix: str) -> Column:
        return F.exists(F.map_keys(self.attrs), lambda n: n.startswith(prefix))


@dataclass(frozen=True)
class LinkRule:
    """``value`` of every element where ``when`` holds, under ``label``.

    ``value`` may be an array, then each item is a link. ``follow`` marks the
    links a crawl walks along; ``inside`` those the inside-path option restricts.
    ``element_text`` says that the text of elements is needed, with that of their
    descendants; ``text_in_tag`` that it is only where the start tag has these
    characters, and ``text_holds_url`` only where the text has ``://``; ``scripts_only`` that the rule is about the bodies of scripts, which
    are then searched once per page. ``bare`` says that tags without attributes
    give links too; ``anywhere`` names attributes read on more tags than
    ``ATTRIBUTE_TAGS`` has.
    """

    label: str | Callable[[Element], Column]
    when: Callable[[Element], Column]
    value: Callable[[Element], Column]
    many: bool = False
    follow: bool = False
    inside: bool = False
    element_text: bool = False
    text_in_tag: str = ""
    text_holds_url: bool = False
    scripts_only: bool = False
    bare: bool = False
    anywhere: tuple[str, ...] = ()

    def label_column(self, e: Element) -> Column:
        return F.lit(self.label) if isinstance(self.label, str) else self.label(e)


def attr_rule(label: str, tag: str, name: str) -> LinkRule:
    """Non-empty attribute ``name`` of ``tag`` elements."""
    return LinkRule(label, lambda e: e.is_(tag) & (e.attr(name) != ""), lambda e: e.attr(name))


def _http(value: Column) -> Column:
    return value.startswith("http://") | value.startswith("https://")


def _socket(value: Column) -> Column:
    return value.startswith("ws://") | value.startswith("wss://")


def _social(e: Element) -> Column:
    return e.is_("meta") & (e.attr("property").startswith("og:") | e.attr("name").startswith("twitter:"))


def _social_label(e: Element) -> Column:
    named = F.when(e.attr("property") != "", e.attr("property")).otherwise(e.attr("name"))
    return F.concat(F.lit("social-media-"), named)


def _webp(e: Element) -> Column:
    return e.is_("img") & e.attr("src").contains(".webp")


# Labels below are fixed values.
ANCHOR = LinkRule("href", lambda e: e.is_("a") & e.has("href"), lambda e: e.attr("href"), follow=True, inside=True)
SCRIPT = LinkRule("script", lambda e: e.is_("script") & e.has("src"), lambda e: e.attr("src"))
FORM = LinkRule("form", lambda e: e.is_("form") & e.has("action"), lambda e: e.attr("action"))
JSCODE = LinkRule(
    "jscode", lambda e: e.is_("script"), lambda e: urls_in_text(e.text), many=True, scripts_only=True
)
CSS = LinkRule("css", lambda e: e.is_("link") & (e.attr("rel") == "stylesheet"), lambda e: e.attr("href"))
EMBEDDED = LinkRule("embedded", lambda e: e.attr("src") != "", lambda e: e.attr("src"))
INTERACTIVE = LinkRule(
    "interactive",
    lambda e: e.is_("a", "button", "form", "select")
    & _http(e.attr("href"))
    & (~e.is_("form") | e.has("action")),
    lambda e: e.attr("href"),
)

CORE = (ANCHOR, SCRIPT, FORM, JSCODE, CSS, EMBEDDED, INTERACTIVE)

ANY_HREF = LinkRule("href", lambda e: e.attr("href") != "", lambda e: e.attr("href"))
ANY_SRC = LinkRule("src", lambda e: e.attr("src") != "", lambda e: e.attr("src"))
META = attr_rule("meta", "meta", "content")
FEED = LinkRule(
    "feed",
    lambda e: e.is_("link") & e.attr("type").isin(*fixed.FEED_TYPES) & (e.attr("href") != ""),
    lambda e: e.attr("href"),
)
WEBP = LinkRule("webp-image", _webp, lambda e: e.attr("src"))
MANIFEST = LinkRule(
    "manifest",
    lambda e: e.is_("link") & (e.attr("rel") == "manifest") & (e.attr("href") != ""),
    lambda e: e.attr("href"),
)
SOCIAL = LinkRule(_social_label, lambda e: _social(e) & (e.attr("content") != ""), lambda e: e.attr("content"))
SITEMAP = LinkRule("sitemap", lambda e: e.is_("a") & e.attr("href").endswith(".xml"), lambda e: e.attr("href"))
DATA_URI = LinkRule("data-uri", lambda e: e.attr("src").startswith("data:"), lambda e: e.attr("src"))
WEBSOCKET = LinkRule("websocket", lambda e: e.is_("script") & _socket(e.attr("src")), lambda e: e.attr("src"))
FRAME = LinkRule(
    "frame",
    lambda e: (e.is_("frame") | (e.is_("frameset") & (e.attr("frameborder") == "1"))) & (e.attr("src") != ""),
    lambda e: e.attr("src"),
)

FULL = CORE + (
    ANY_HREF,
    ANY_SRC,
    META,
    attr_rule("video", "video", "src"),
    attr_rule("audio", "audio", "src"),
    attr_rule("embed", "embed", "src"),
    attr_rule("track", "track", "src"),
    attr_rule("area", "area", "href"),
    attr_rule("applet", "applet", "archive"),
    attr_rule("base", "base", "href"),
    attr_rule("bgsound", "bgsound", "src"),
    attr_rule("body-background", "body", "background"),
    FEED,
    WEBP,
    MANIFEST,
    SOCIAL,
    SITEMAP,
    DATA_URI,
    WEBSOCKET,
    FRAME,
)

# Off unless asked for.
DATA = LinkRule("data", lambda e: e.has_prefix("data-") & (e.text != ""), lambda e: e.text, element_text=True, text_in_tag="-")
CUSTOM_DATA = LinkRule(
    "custom-data", lambda e: e.has_prefix("data-custom-") & (e.text != ""), lambda e: e.text, element_text=True, text_in_tag="-"
)

# URLs in the text of a page; made per page, not per element.
PAGE_TEXT = "custom_REGEX"


def _exclusive_label(e: Element) -> Column:
    return (
        F.when(e.is_("a") & (e.attr("href") != ""), "href")
        .when(e.is_("script") & (e.attr("src") != ""), "script")
        .when(e.is_("form") & (e.attr("action") != ""), "form")
        .when(e.is_("link") & (e.attr("rel") == "stylesheet"), "css")
        .when(_webp(e), "webp-image")
        .when(e.is_("link") & (e.attr("rel") == "manifest"), "manifest")
        .when(_social(e), _social_label(e))
        .when(_socket(e.attr("src")), "websocket")
        .when(e.is_("frame") & (e.attr("src") != ""), "frame")
        .when(e.attr("src") != "", "embedded")
    )


def _exclusive_value(e: Element) -> Column:
    return (
        F.when(e.is_("a"), F.when(e.attr("href") != "", e.attr("href")).otherwise(e.attr("src")))
        .when(e.is_("form") & (e.attr("action") != ""), e.attr("action"))
        .when(e.is_("link") & e.attr("rel").isin("stylesheet", "manifest"), e.attr("href"))
        .when(_social(e), e.attr("content"))
        .otherwise(e.attr("src"))
    )


# One label per element, the first that fits.
EXCLUSIVE = (
    LinkRule(
        _exclusive_label,
        lambda e: e.is_("a") & (e.attr("href") != ""),
        _exclusive_value,
        follow=True,
        inside=True,
    ),
    LinkRule(
        _exclusive_label,
        lambda e: ~(e.is_("a") & (e.attr("href") != "")) & (_exclusive_value(e) != ""),
        _exclusive_value,
        inside=True,
    ),
    LinkRule(
        "jscode",
        lambda e: e.is_("script") & (e.attr("src") == ""),
        lambda e: urls_in_text(e.text),
        many=True,
        scripts_only=True,
    ),
)


def _in_core_group(e: Element) -> Column:
    return (
        (e.is_("a", "button") & e.has("href"))
        | e.is_("script", "iframe", "img", "select")
        | (e.is_("form") & e.has("action"))
        | (e.is_("link") & (e.attr("rel") == "stylesheet"))
        | e.has("src")
    )


def _grouped(label: str, value: Callable[[Element], Column], **kind) -> LinkRule:
    return LinkRule(label, _in_core_group, value, bare=True, anywhere=("action",), **kind)


def _in_second_group(e: Element) -> Column:
    """Elements the second selector group names at all."""
    return (
        (e.is_("video", "audio", "embed", "track", "bgsound") & e.has("src"))
        | (e.is_("area", "base") & e.has("href"))
        | (e.is_("applet") & e.has("archive"))
        | (e.is_("body") & e.has("background"))
        | (e.is_("link") & (e.attr("type").isin(*fixed.FEED_TYPES) | (e.attr("rel") == "manifest")))
        | _webp(e)
        | _social(e)
        | (e.is_("a") & e.attr("href").endswith(".xml"))
        | e.attr("src").startswith("data:")
        | (e.is_("script") & _socket(e.attr("src")))
        | (e.is_("frame") & e.has("src"))
        | (e.is_("frameset") & (e.attr("frameborder") == "1"))
    )


_SRC_TAGS = ("video", "audio", "embed", "track", "bgsound")
_HREF_TAGS = ("area", "base")


def _second(e: Element) -> Column:
    """Label and value of the second group, chosen together."""
    href, src = e.attr("href"), e.attr("src")
    pair = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    return (
        F.when(e.is_(*_SRC_TAGS), pair(e.tag, src))
        .when(e.is_(*_HREF_TAGS), pair(e.tag, href))
        .when(e.is_("applet"), pair(e.tag, e.attr("archive")))
        .when(e.is_("body"), pair(F.lit("body-background"), e.attr("background")))
        .when(e.is_("link"), F.when(_contains_feed(e), pair(F.lit("feed"), href)))
        .when(_webp(e), pair(F.lit("webp-image"), src))
        .when(_social(e), pair(_social_label(e), e.attr("content")))
        .when(e.is_("a") & href.endswith(".xml"), pair(F.lit("sitemap"), href))
        .when(src.startswith("data:"), pair(F.lit("data-uri"), src))
        .when(_socket(src), pair(F.lit("websocket"), src))
        .when(e.is_("frame", "frameset"), pair(F.lit("frame"), src))
    )


def _contains_feed(e: Element) -> Column:
    first, *others = [e.attr("type").contains(t) for t in fixed.FEED_TYPES]
    for other in others:
        first = first | other
    return first


# Every element of the core group gives every core label, and at most one label
# of the second group, chosen by tag.
GROUPED = (
    _grouped("href", lambda e: e.attr("href"), follow=True, inside=True),
    _grouped("script", lambda e: e.attr("src")),
    _grouped("form", lambda e: e.attr("action")),
    _grouped("jscode", lambda e: urls_in_text(e.text), many=True, element_text=True, text_holds_url=True),
    _grouped("css", lambda e: e.attr("href")),
    EMBEDDED,
    JSCODE,
    CSS,
    LinkRule("interactive", lambda e: _in_core_group(e) & _http(e.attr("href")), lambda e: e.attr("href")),
    ANY_HREF,
    ANY_SRC,
    META,
    LinkRule(
        lambda e: _second(e)["label"],
        lambda e: _in_second_group(e) & _second(e)["label"].isNotNull() & (e.is_("link") | (_second(e)["value"] != "")),
        lambda e: _second(e)["value"],
    ),
)

# The plain profile: links a simple parser finds, labelled by construct.
PLAIN_HREF = LinkRule("py_href", lambda e: e.is_("a", "script", "link") & e.has("href"), lambda e: e.attr("href"))
PLAIN_SCRIPT = LinkRule("py_script", lambda e: e.is_("script") & e.attr("src").rlike(r"\.js\n?\z"), lambda e: e.attr("src"))
PLAIN_STYLE = LinkRule(
    "py_style",
    lambda e: e.is_("link")
    & F.array_contains(F.split(e.attr("rel"), r"[\t\n\f\r ]+"), "stylesheet")
    & e.attr("href").rlike(r"\.css\n?\z"),
    lambda e: e.attr("href"),
)
PLAIN_THIRD_PARTY = LinkRule(
    "py_third_party",
    lambda e: e.is_("script") & (e.attr("src").contains("http://") | e.attr("src").contains("https://")),
    lambda e: e.attr("src"),
)
PLAIN = (PLAIN_HREF, PLAIN_SCRIPT, PLAIN_STYLE, PLAIN_THIRD_PARTY)

# Attributes that the rules of this module read on these tags only, but for those a
# rule reads anywhere. The others are parsed on every tag.
ATTRIBUTE_TAGS = {
    "action": ("form",), "content": ("meta",), "property": ("meta",), "name": ("meta",),
    "background": ("body",), "archive": ("applet",), "frameborder": ("frameset",),
    "rel": ("link",), "type": ("link",),
}
BUILT_IN = frozenset(id(r) for r in (*FULL, DATA, CUSTOM_DATA, *EXCLUSIVE, *GROUPED, *PLAIN))

PROFILES: dict[str, tuple[LinkRule, ...]] = {
    "core": CORE,
    "full": FULL,
    "exclusive": EXCLUSIVE,
    "grouped": GROUPED,
}


def by_label(label: str) -> tuple[LinkRule, ...]:
    """The rules of the full set, and the optional ones, that give ``label``.

    ``social-media`` stands for all labels that begin so.
    """
    if label == "social-media":
        return (SOCIAL,)
    found = tuple(r for r in (*FULL, DATA, CUSTOM_DATA) if r.label == label)
    if not found:
        raise KeyError(label)
    return found
