"""Rendered forms of a link, and header strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def render_line(
    url: Column, source: Column, where_url: Column, show_source: bool = False, show_where: bool = False
) -> Column:
    """``[where] [source] url`` with the parts that are asked for."""
    parts = []
    if show_where:
        parts += [F.lit("["), where_url, F.lit("] ")]
    if show_source:
        parts += [F.lit("["), source, F.lit("] ")]
    return F.concat(*parts, url)


def render_json(url: Column, source: Column, where_url: Column, show_where: bool = False) -> Column:
    """One JSON object per link, keys ``Source``, ``URL``, ``Where``.

    ``<``, ``>``, ``&`` and the two Unicode line separators are written as
    escapes, so the text can sit inside an HTML page.
    """
    body = F.to_json(
        F.struct(
            F.coalesce(source, F.lit("")).alias("Source"),
            F.coalesce(url, F.lit("")).alias("URL"),
            (F.coalesce(where_url, F.lit("")) if show_where else F.lit("")).alias("Where"),
        )
    )
    for char, escape in (
        ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"),
        (chr(0x2028), "\\u2028"), (chr(0x2029), "\\u2029"),
    ):
        body = F.replace(body, F.lit(char), F.lit(escape))
    return body


def parse_headers(raw: Column) -> Column:
    """``A: b;;C:d`` as a map; the last of two equal names wins.

    NULL where there is text but no colon at all; empty text is an empty map.
    """
    items = F.filter(F.split(raw, ";;"), lambda item: item.contains(":"))
    pairs = F.transform(items, _header)
    names = F.transform(pairs, lambda p: p["name"])
    last_first = F.reverse(pairs)
    unique = F.array_distinct(names)
    values = F.transform(
        unique,
        lambda n: F.element_at(F.filter(last_first, lambda p: p["name"] == n), 1)["value"],
    )
    return F.when((raw == "") | raw.contains(":"), F.map_from_arrays(unique, values))


_BLANKS = " \t\n\x0b\f\r"


def _header(item: Column) -> Column:
    mark = F.when(item.contains(": "), F.lit(": ")).otherwise(F.lit(":"))
    at = F.instr(item, mark)
    return F.struct(
        F.trim(F.substr(item, F.lit(1), at - 1), F.lit(_BLANKS)).alias("name"),
        F.trim(F.substr(item, at + F.length(mark)), F.lit(_BLANKS)).alias("value"),
    )
