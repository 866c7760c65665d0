"""Character references (``&amp;``, ``&#38;``, ``&#x26;``) as column expressions."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR, _KEY = "\x1e", "\x1f"


def _usual(name: str) -> bool:
    """An HTML 4 name or a name of ASCII characters."""
    return name.rstrip(";") in name2codepoint or html5[name].isascii()


def _listed(names: list[str]) -> str:
    return _PAIR.join(f"{name}{_KEY}{html5[name]}" for name in names)


# All names of the standard, with and without ";" where it allows both. The usual
# ones are looked up first; the rest is a table ten times that size.
_NAMED = _listed([name for name in sorted(html5) if _usual(name)])
_RARE = _listed([name for name in sorted(html5) if not _usual(name)])
# Numbers 128..159 mean the Windows-1252 characters.
_CP1252 = "".join(bytes([i]).decode("cp1252", errors="replace") for i in range(128, 160))
_REPLACEMENT = "�"

_IN_TEXT = r"&#[xX][0-9a-fA-F]++;?+|&#[0-9]++;?+|&[A-Za-z][A-Za-z0-9]*+;?+|[^&]++|&"
# In an attribute value a name without ";" that runs into "=" is left alone.
_IN_ATTRIBUTE = r"&#[xX][0-9a-fA-F]++;?+|&#[0-9]++;?+|&[A-Za-z][A-Za-z0-9]*+[;=]?+|[^&]++|&"


def _character(code: Column) -> Column:
    known = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit(_REPLACEMENT))
        .when(code.between(128, 159), F.substring(F.lit(_CP1252), (code - 127).cast("int"), F.lit(1)))
        .otherwise(known)
    )


def _number(piece: Column, prefix: int, base: int) -> Column:
    digits = F.ltrim(F.rtrim(F.substr(piece, F.lit(prefix + 1)), F.lit(";")), F.lit("0"))
    # more than seven digits is past the last code point in either base
    return F.when(F.length(digits) == 0, F.lit(0)).when(
        F.length(digits) <= 7, F.conv(digits, base, 10).cast("bigint")
    )


def _reference(piece: Column) -> Column:
    name = F.substr(piece, F.lit(2))
    table, rare = (F.str_to_map(F.lit(names), F.lit(_PAIR), F.lit(_KEY)) for names in (_NAMED, _RARE))
    return (
        F.when((piece == "&amp;"), F.lit("&"))
        .when(piece == "&lt;", F.lit("<"))
        .when(piece == "&gt;", F.lit(">"))
        .when(piece == "&quot;", F.lit('"'))
        .when(piece.startswith("&#x") | piece.startswith("&#X"), _character(_number(piece, 3, 16)))
        .when(piece.rlike("^&#[0-9]"), _character(_number(piece, 2, 10)))
        .when(piece.rlike("^&[A-Za-z]"), F.coalesce(F.element_at(table, name), F.element_at(rare, name), piece))
        .otherwise(piece)
    )


def decode_entities(text: Column, in_attribute: bool = False) -> Column:
    """Replace named and numeric character references in ``text``."""
    pieces = F.regexp_extract_all(text, F.lit(_IN_ATTRIBUTE if in_attribute else _IN_TEXT), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, _reference), "")).otherwise(text)
