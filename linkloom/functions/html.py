"""HTML markup as column expressions.

One regular expression cuts a page into comments, raw-text elements and start
tags, following the tokenizer rules of the HTML standard. Every repeat is
possessive, so java.util.regex neither backtracks nor recurses and the cost is
linear in the size of the page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom import fixed
from linkloom.functions.binding import let
from linkloom.functions.entities import decode_entities

_WS = r"[\t\n\f\r ]"
_GAP = r"[\t\n\f\r /]*+"
_NAME = r"[^\t\n\f\r />][^\t\n\f\r />=]*+"
_VALUE = r"\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z)|[^\t\n\f\r >\"'][^\t\n\f\r >]*+"
_ATTRIBUTE = rf"{_NAME}(?:{_WS}*+={_WS}*+(?:{_VALUE})?+)?+"
_TAG_NAME = r"[a-z][^\t\n\f\r />]*+"
_TAG_BODY = rf"{_GAP}(?:{_ATTRIBUTE}{_GAP})*+"
_START_TAG = rf"<{_TAG_NAME}{_TAG_BODY}>"
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))|<[!?][^>]*+(?:>|\z)"


def _raw_element(tags: tuple[str, ...], group: int) -> str:
    """Start tag, content (group ``group + 1``) and end tag of a raw-text element."""
    closing = rf"</\{group}(?=[\t\n\f\r />]|\z)"
    return (
        rf"<({'|'.join(tags)})(?=[\t\n\f\r />]){_TAG_BODY}>"
        rf"((?:[^<]++|(?!{closing})<)*+)(?:{closing}[^>]*+>?+)?+"
    )


def tokens(
    html: Column, raw_tags: tuple[str, ...] = fixed.RAW_TEXT_TAGS, with_text: bool = True
) -> Column:
    """Markup of a page in order: comments, whole raw-text elements, and start
    tags, each with the text up to the next ``<`` if ``with_text``."""
    close = "(?:>[^<]*+|\\z)" if with_text else "(?:>|\\z)"
    pattern = rf"(?is){_COMMENT}|{_raw_element(raw_tags, 1)}|<{_TAG_NAME}{_TAG_BODY}{close}"
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def pieces(html: Column, raw_tags: tuple[str, ...] = fixed.RAW_TEXT_TAGS) -> Column:
    """All of a page in order: comments, whole raw-text elements, start tags, end tags, and text."""
    pattern = (
        rf"(?is){_COMMENT}|{_raw_element(raw_tags, 1)}|<{_TAG_NAME}{_TAG_BODY}(?:>|\z)"
        r"|</[a-z][^>]*+(?:>|\z)|[^<]++|<"
    )
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def complete(tokens: Column) -> Column:
    """Tokens without a last start tag that the end of the page cuts off."""
    last = F.try_element_at(tokens, F.lit(-1))
    cut = last.rlike(r"\A<[A-Za-z]") & ~is_start_tag(last)
    return F.when(cut, F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens)


def is_start_tag(token: Column) -> Column:
    """True for tokens that open an element (and are not cut off by the end)."""
    return token.rlike(rf"(?i)\A{_START_TAG}")


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"\A<([A-Za-z][^\t\n\f\r />]*)", 1))


def attribute_as_written(token: Column, name: str) -> Column:
    """One attribute of a start tag from its name on, empty when absent."""
    this = rf"{re.escape(name)}(?=[\t\n\f\r />=])"
    return F.regexp_extract(
        token,
        rf"(?i)\A<{_TAG_NAME}{_GAP}(?:(?!{this}){_ATTRIBUTE}{_GAP})*+({this}(?:{_WS}*+={_WS}*+(?:{_VALUE})?+)?+)",
        1,
    )


def value_as_written(found: Column) -> Column:
    """Value of an attribute that ``attribute_as_written`` gave, NULL for none, character
    references as written. Plain string work, so it stays inside generated code."""
    mark = F.instr(found, "=")
    value = F.ltrim(F.substr(found, mark + 1), F.lit(" \t\n\f\r"))
    quoted = value.startswith('"') | value.startswith("'")
    return (
        F.when(found == "", F.lit(None).cast("string"))
        .when(mark == 0, F.lit(""))
        .when(quoted, F.substr(value, F.lit(2), F.length(value) - 2))
        .otherwise(value)
    )


def attribute(token: Column, name: str) -> Column:
    """One attribute of a start tag, NULL when absent, character references as
    written."""
    return value_as_written(attribute_as_written(token, name))


def attributes(token: Column) -> Column:
    """Attribute map of a start tag: lower-case names, decoded values, the first
    of two equal names wins."""
    step = rf"(?i)\G(?:\A<{_TAG_NAME}{_GAP})?+({_NAME})(?:{_WS}*+={_WS}*+({_VALUE})?+)?+{_GAP}"
    names = F.transform(F.regexp_extract_all(token, F.lit(step), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(token, F.lit(step), F.lit(2)), _attribute_value)

    def first_wins(pair: Column) -> Column:
        unique = F.array_distinct(pair["names"])
        first = F.transform(
            unique, lambda n: F.element_at(pair["values"], F.array_position(pair["names"], n).cast("int"))
        )
        repeated = F.size(unique) < F.size(pair["names"])
        return F.map_from_arrays(unique, F.when(repeated, first).otherwise(pair["values"]))

    parsed = let(F.struct(names.alias("names"), values.alias("values")), first_wins)
    none = F.create_map().cast("map<string,string>")
    return F.when(token.rlike(_HAS_ATTRIBUTE), parsed).otherwise(none)


_HAS_ATTRIBUTE = r"\A<[A-Za-z][^\t\n\f\r />]*+[\t\n\f\r /]++[^\t\n\f\r />]"


def _attribute_value(raw: Column) -> Column:
    quoted = F.substr(raw, F.lit(2), F.length(raw) - 2)
    return decode_entities(
        F.when(raw.startswith('"') | raw.startswith("'"), quoted).otherwise(raw), in_attribute=True
    )


def raw_body(token: Column) -> Column:
    """Content of a raw-text element, as written."""
    return F.regexp_extract(token, rf"(?is)\A{_START_TAG}(.*?)(?:</[a-z]++[^<>]*+>?+)?\z", 1)


def element_text(token: Column, tag: Column, raw_tags: tuple[str, ...] = fixed.RAW_TEXT_TAGS) -> Column:
    """Content of a raw-text element; for others the text right after the start tag."""
    lead = F.regexp_extract(token, rf"(?is)\A{_START_TAG}(.*)", 1)
    undecoded = [t for t in raw_tags if t not in fixed.DECODED_RAW_TAGS]
    decoded = [t for t in raw_tags if t in fixed.DECODED_RAW_TAGS]
    text = F.when(tag.isin(undecoded), raw_body(token))
    if decoded:
        text = text.when(tag.isin(decoded), decode_entities(raw_body(token)))
    return text.otherwise(decode_entities(lead))


# Marks that cannot come from HTML text: a boundary between text nodes, and the
# two ends of raw text.
_NODE, _RAW_FROM, _RAW_TO = "\x01", "\x02", "\x03"


def marked_text(html: Column, raw_tags: tuple[str, ...] = fixed.RAW_TEXT_TAGS) -> Column:
    """All text of a page in order, with marks where markup was taken out."""
    opaque = tuple(t for t in raw_tags if t not in fixed.DECODED_RAW_TAGS)
    pattern = (
        rf"(?is){_COMMENT}|{_raw_element(opaque, 1)}"
        rf"|<{_TAG_NAME}{_TAG_BODY}(?:>|\z)|</[a-z][^>]*+(?:>|\z)"
    )
    clean = F.when(html.rlike(r"[\x01-\x03]"), F.translate(html, "\x01\x02\x03", "")).otherwise(html)
    return F.regexp_replace(clean, pattern, f"{_NODE}{_RAW_FROM}$2{_RAW_TO}{_NODE}")


def may_hold_url(marked: Column) -> Column:
    """False where no decoding could bring up a URL: most pages end here."""
    # the plain form is by far the most common, and the cheapest to find
    return marked.contains("://") | marked.rlike("|".join(_across(found) for found in ("://", "&#", "&colon", "&sol")))


def _across(text: str) -> str:
    """A pattern for ``text`` with marks anywhere in it."""
    return rf"[{_NODE}-{_RAW_TO}]*+".join(text)


def node_texts(marked: Column) -> Column:
    """Text with every node on lines of its own: no URL can run across nodes."""
    return F.regexp_replace(marked, rf"[{_NODE}-{_RAW_TO}]", "\n")


def document_text(marked: Column) -> Column:
    """Text of all nodes put together, as the root element has it."""
    return F.regexp_replace(marked, rf"[{_NODE}-{_RAW_TO}]++", "")


def decode_marked(marked: Column) -> Column:
    """Decode character references everywhere but between the raw-text marks."""
    pieces = F.regexp_extract_all(
        marked, F.lit(rf"{_RAW_FROM}[^{_RAW_TO}]*+{_RAW_TO}|[^{_RAW_FROM}]++"), F.lit(0)
    )
    decoded = F.transform(
        pieces, lambda p: F.when(p.startswith(_RAW_FROM), p).otherwise(decode_entities(p))
    )
    return F.when(marked.rlike(_REFERENCE), F.array_join(decoded, "")).otherwise(marked)


# A character reference may begin outside the raw-text marks.
_REFERENCE = rf"\A(?:[^&{_RAW_FROM}]++|{_RAW_FROM}[^{_RAW_TO}]*+{_RAW_TO})*+&"
