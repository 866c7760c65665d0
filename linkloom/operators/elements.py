"""Pages to elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom import fixed
from linkloom.functions import html as H


def html_elements(pages: DataFrame, raw_tags: tuple[str, ...] = fixed.RAW_TEXT_TAGS) -> DataFrame:
    """``(url, html)`` to ``(url, ord, tag, attrs, text)``, one row per start tag.

    ``ord`` counts the markup of a page, comments included. The plan is one scan
    and one generator: no shuffle. The outer generator keeps the optimizer from
    running the tokenizer a second time to test for emptiness.
    """
    token = F.col("token")
    return (
        pages.select("url", F.posexplode_outer(H.tokens(F.col("html"), raw_tags)).alias("pos", "token"))
        .where(H.is_start_tag(token))
        .select(
            "url",
            (F.col("pos") + 1).alias("ord"),
            H.tag_name(token).alias("tag"),
            H.attributes(token).alias("attrs"),
            H.element_text(token, H.tag_name(token), raw_tags).alias("text"),
        )
    )
