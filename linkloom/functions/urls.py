"""URL columns: host, domain, absolute form, content-type test."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.binding import let

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"
# A control character, a broken percent escape, or a blank in the authority
# makes the whole string no URL.
_NOT_A_URL = r"[\x00-\x1f\x7f]|%(?![0-9A-Fa-f]{2})|^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]* "
# References that do not parse: the same, but what follows a scheme without a slash
# and what a query holds may have any percent sign.
_NOT_A_REFERENCE = (
    r"[\x00-\x1f\x7f]|^(?![A-Za-z][A-Za-z0-9+.-]*+:[^/])[^?#]*%(?![0-9A-Fa-f]{2})|#.*%(?![0-9A-Fa-f]{2})"
    r"|^(?:[A-Za-z][A-Za-z0-9+.-]*+:)?//[^/?#]* "
)
_ORIGIN = r"^[A-Za-z][A-Za-z0-9+.-]*+:(?://[^/?#]*+)?+"
_DOT_SEGMENT = r"(^|/)\.\.?(/|$)"


def is_absolute_url(url: Column) -> Column:
    """True where ``url`` parses and names its scheme."""
    return F.coalesce(url.rlike(_SCHEME) & ~url.rlike(_NOT_A_URL), F.lit(False))


def host_of(url: Column) -> Column:
    """Host without user info, port and brackets; NULL unless absolute."""
    bracketed = F.regexp_extract(url, _AUTHORITY + r"\[([^\]]*)\]", 1)
    plain = F.regexp_extract(url, _AUTHORITY + r"([^\[\]:/?#]*)", 1)
    return F.when(is_absolute_url(url), F.when(bracketed != "", bracketed).otherwise(plain))


def main_domain(url: Column) -> Column:
    """Last two host labels joined by ``_``; NULL when there are fewer."""
    return domain_of_host(host_of(url))


def domain_of_host(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.when(
        F.size(labels) >= 2,
        F.concat_ws("_", F.element_at(labels, -2), F.element_at(labels, -1)),
    )


def seed_domain(url: Column) -> Column:
    """Text after the last ``//`` up to the first ``/``."""
    return F.substring_index(F.substring_index(url, "//", -1), "/", 1)


def is_textual(content_type: Column) -> Column:
    """Content types worth reading for links."""
    return content_type.startswith("text/") | (content_type == "application/javascript")


@dataclass(frozen=True)
class Base:
    """The parts of a base URL that references are put onto.

    Kept as columns so that a job can compute them once per page and carry them
    next to every link of the page.
    """

    whole: Column
    scheme: Column
    origin: Column
    document: Column
    directory: Column

    FIELDS = ("whole", "scheme", "origin", "document", "directory")

    @classmethod
    def of(cls, url: Column) -> "Base":
        origin = F.regexp_extract(url, _ORIGIN, 0)
        document = F.regexp_extract(url, r"^[^?#]*", 0)
        path = F.regexp_extract(url, _ORIGIN + r"([^?#]*/)", 1)
        directory = F.when(path == "", F.lit("/")).otherwise(path)
        scheme = F.regexp_extract(url, _SCHEME, 0)
        return cls(url, scheme, origin, document, directory)

    def to_struct(self) -> Column:
        return F.struct(*[getattr(self, f).alias(f) for f in self.FIELDS])

    @classmethod
    def from_struct(cls, column: str) -> "Base":
        return cls(*[F.col(f"{column}.{f}") for f in cls.FIELDS])


def _drop_dot_segments(path: Column) -> Column:
    def fold(segments: Column) -> Column:
        kept = F.aggregate(
            F.slice(segments, F.lit(2), F.size(segments)),
            F.array().cast("array<string>"),
            lambda kept, part: F.when(part == ".", kept)
            .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(part))),
        )
        # a path that ends in a dot segment names a directory
        ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, ends), "/"))

    return F.when(path.rlike(_DOT_SEGMENT), let(F.split(path, "/"), fold)).otherwise(path)


def fetch_key(url: Column) -> Column:
    """What tells pages apart when they are fetched: no fragment, scheme and host in
    lower case, no default port, ``/`` for an empty path, dot segments removed.

    Most URLs are in that form already, which one test tells."""
    return F.when(in_fetch_form(url), url).otherwise(_fetch_key(url))


def in_fetch_form(url: Column) -> Column:
    """True for most URLs that are their own fetch key; their host is all between the slashes."""
    return F.coalesce(url.rlike(_FETCH_FORM) & ~url.contains("/."), F.lit(False))


# A plain host in lower case without a port, a path, and no fragment.
_FETCH_FORM = r"\Ahttps?://[a-z0-9_-][a-z0-9._-]*+/[^#%\\\[\]\x00-\x20\x7f]*+\z"


def _fetch_key(url: Column) -> Column:
    bare = F.regexp_extract(url, r"^[^#]*", 0)
    authority = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0))
    authority = F.regexp_replace(F.regexp_replace(authority, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*((?s:.*))$", 1)
    path, query = F.regexp_extract(rest, r"^[^?]*", 0), F.regexp_extract(rest, r"\?(?s:.*)", 0)
    path = F.when(path == "", F.lit("/")).otherwise(_drop_dot_segments(path))
    return F.when(authority == "", bare).otherwise(F.concat(authority, path, query))


def percent_encode(url: Column) -> Column:
    """Percent-encode blanks and everything outside ASCII."""
    pieces = F.regexp_extract_all(url, F.lit(r"[^\x00-\x7f]++| |[\x00-\x1f\x21-\x7f]++"), F.lit(0))
    encoded = F.transform(
        pieces,
        lambda p: F.when(p == " ", F.lit("%20")).when(p.rlike(r"^[^\x00-\x7f]"), F.url_encode(p)).otherwise(p),
    )
    return F.when(url.rlike(r"[^\x00-\x7f]| "), F.array_join(encoded, "")).otherwise(url)


def _without_dots(url: Column) -> Column:
    """An absolute URL whose path, if it begins with a slash, has no dot segments."""
    origin = F.regexp_extract(url, _ORIGIN, 0)
    path = F.regexp_extract(url, _ORIGIN + r"(/[^?#]*)", 1)
    rest = F.regexp_extract(url, r"[?#](?s:.*)", 0)
    dotted = url.rlike(r"/\.\.?(?:[/?#]|\z)") & (path != "")
    return F.when(dotted, F.concat(origin, _drop_dot_segments(path), rest)).otherwise(url)


def resolve(
    link: Column, base: Base, keep_fragment: bool = False, encode: str = "none", lenient: bool = False
) -> Column:
    """RFC 3986 reference resolution onto prepared base parts.

    ``#frag`` gives NULL unless ``keep_fragment``; an empty link is the base
    itself. ``lenient`` takes links with a scheme or a host as written, dot
    segments included.
    """
    fragment = F.concat(F.regexp_extract(base.whole, r"^[^#]*", 0), link) if keep_fragment else F.lit(None)
    path = F.regexp_extract(link, r"^[^?#]*", 0)
    rest = F.regexp_extract(link, r"[?#](?s:.*)", 0)
    whole = (lambda url: url) if lenient else _without_dots
    rooted = F.when(link.startswith("/"), path).otherwise(F.concat(base.directory, path))
    resolved = (
        F.when(link.rlike(_SCHEME), whole(link))
        .when(link == "", base.whole)
        .when(link.startswith("#"), fragment)
        .when(link.startswith("//"), whole(F.concat(base.scheme, link)))
        .when(link.startswith("?"), F.concat(base.document, link))
        .otherwise(F.concat(base.origin, _drop_dot_segments(rooted), rest))
    )
    if encode == "path":
        return percent_encode(resolved)
    if encode != "none":
        raise ValueError(f"encode must be 'none' or 'path', not {encode!r}")
    return resolved


def plain(link: Column) -> Column:
    """True for most links that are rooted or begin with a web scheme: nothing in them is trimmed, dropped or refused."""
    return F.coalesce(link.rlike(_PLAIN) & ~link.startswith("//") & ~link.contains("/."), F.lit(False))


# A path or a whole address of visible ASCII without a fragment or percent signs.
_PLAIN = r"\A(?:https?:/)?/[!\"$&-~]*+\z"


def resolve_plain(link: Column, base: Base) -> Column:
    """``resolve`` of ``plain`` links, without looking at each part."""
    return F.when(link.startswith("/"), F.concat(base.origin, link)).otherwise(link)


def parses(link: Column) -> Column:
    """False for references that no parser of URLs takes."""
    return ~link.rlike(_NOT_A_REFERENCE)


def resolves(link: Column, base: Base, keep_fragment: bool = False) -> Column:
    """True where ``resolve`` gives a URL. Far cheaper than resolving."""
    empty = (link == "") & (base.whole == "")
    return link.isNotNull() & ~empty if keep_fragment else ~link.startswith("#") & ~empty


def trim_link(link: Column) -> Column:
    """Drop blanks and controls around a link and line breaks inside it."""
    return F.when(
        link.rlike(r"^[\x00-\x20]|[\x00-\x20]$|[\t\n\r]"),
        F.regexp_replace(link, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]+", ""),
    ).otherwise(link)


def absolute_url(
    link: Column, base: Column, keep_fragment: bool = False, encode: str = "none", lenient: bool = False
) -> Column:
    """``link`` as seen on the page ``base``, made absolute."""
    pair = F.struct(trim_link(link).alias("link"), Base.of(base).to_struct().alias("base"))
    return let(
        pair,
        lambda p: resolve(p["link"], Base(*[p["base"][f] for f in Base.FIELDS]), keep_fragment, encode, lenient),
    )
