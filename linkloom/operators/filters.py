"""Row filters: keywords, scope, content gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import host_of, is_textual

# Up to this many keywords the tests are compiled into the plan one by one; a
# longer list is one array literal, with the same result.
COMPILED_KEYWORDS = 200


def keyword_predicate(text: Column, keywords: Sequence[str]) -> Column:
    """Case-sensitive: ``text`` contains any keyword. No keywords keep everything,
    and so does an empty keyword. For a list in a table, of any size, there is
    ``lookups.keyword_semi_join``."""
    if not keywords or "" in keywords:
        return text.isNotNull()
    if len(keywords) > COMPILED_KEYWORDS:
        listed = F.lit(list(dict.fromkeys(keywords)))
        return F.exists(listed, lambda k: F.contains(text, k))
    return _any([text.contains(k) for k in dict.fromkeys(keywords)])


def _any(tests: list[Column]) -> Column:
    """Or of ``tests`` as a balanced tree: a chain would nest as deep as it is long."""
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) // 2 * 2:]
    return tests[0]


def keyword_filter(links: DataFrame, keywords: Sequence[str], column: str = "raw") -> DataFrame:
    """Keep rows whose ``column`` contains a keyword."""
    return links.where(keyword_predicate(F.col(column), keywords))


def in_scope_host(url: Column, *hosts: Column) -> Column:
    """Host of ``url`` equals one of ``hosts``."""
    return _any([F.coalesce(host_of(url) == h, F.lit(False)) for h in hosts])


def in_scope_subdomains(url: Column, host: Column) -> Column:
    """``url`` names ``host`` after a dot or a double slash, anywhere."""
    return url.contains(F.concat(F.lit("."), host)) | url.contains(F.concat(F.lit("//"), host))


def inside_path(url: Column, seed: Column) -> Column:
    """``url`` contains the seed URL."""
    return url.contains(seed)


def gate_textual(captures: DataFrame) -> DataFrame:
    """Captures worth reading: status 200 and a textual content type."""
    return captures.where((F.col("status") == 200) & is_textual(F.col("content_type")))
