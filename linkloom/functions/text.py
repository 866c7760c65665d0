"""URLs in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom import fixed


# From the letters before a "://" to the next character that no URL has.
_AROUND_SCHEME = r"(?<![A-Za-z])[A-Za-z]++://[^\t\n\f\r '\"]*+"


def urls_in_text(text: Column) -> Column:
    """Distinct URLs of any known scheme in ``text``."""
    # no URL runs across these ends, so the long pattern needs to see only what is between them
    runs = F.array_join(F.regexp_extract_all(text, F.lit(_AROUND_SCHEME), F.lit(0)), "\n")
    found = F.array_distinct(F.regexp_extract_all(runs, F.lit(fixed.URL_PATTERN), F.lit(0)))
    return F.when(text.contains("://"), found).otherwise(_none())


def http_urls_in_text(text: Column) -> Column:
    """Loose http(s) runs in ``text``, repeats included."""
    return F.regexp_extract_all(text, F.lit(fixed.HTTP_RUN_PATTERN), F.lit(0))


def origins_in_text(text: Column) -> Column:
    """Scheme, user info, host and port of web addresses in ``text``, repeats included."""
    return F.regexp_extract_all(text, F.lit(fixed.ORIGIN_PATTERN), F.lit(0))


def css_urls(text: Column) -> Column:
    """Quoted arguments of CSS ``url(...)``, repeats included."""
    return F.regexp_extract_all(text, F.lit(fixed.CSS_URL_PATTERN), F.lit(1))


def truncate_body(html: Column, kilobytes: int) -> Column:
    """The first ``kilobytes`` KiB of a body, by bytes; -1 is no limit.

    A character cut in two at the limit is dropped.
    """
    if kilobytes < 0:
        return html
    limit = kilobytes * 1024
    octets = F.encode(html, "UTF-8")
    last = F.hex(F.substring(octets, limit - 2, 3))
    # a lead byte too near the limit begins a character that does not fit
    partial = (
        F.when(last.rlike("[C-F].$"), 1)
        .when(last.rlike("[EF].[89AB].$"), 2)
        .when(last.rlike("F.[89AB].[89AB].$"), 3)
        .otherwise(0)
    )
    head = F.substring(octets, F.lit(1), F.lit(limit) - partial).cast("string")
    return F.when(F.octet_length(html) <= limit, html).otherwise(head)


def _none() -> Column:
    return F.array().cast("array<string>")
