"""Quality rules with cross-document line frequency, by DataFrame functions only.

A line that many documents of one host carry is boilerplate. Normalised lines are
hashed, the documents that have each are counted per host, lines above the limits
are taken out, and a document that keeps too little is rejected.

How it runs: one pass over the texts writes a narrow table (figures of the base
rules and one hash per line). Everything after that moves hashes only. Counting
combines on the map side, so a line that a third of all documents share costs one
row per task; the join that marks lines reads two stored tables, so adaptive
execution can split a hot line.

Defined results: a null text is an empty one, with no words and no lines. Lines
without a word are no lines. Each row is a document of its own, also when ids or
whole rows repeat or the id is null. A null host is a host. An empty table gives an
empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import SPACE, WORD_CHAR, cut_lineage, words

#: A line is above the limit when more documents of its host than ``MIN_DOCS`` and
#: more than ``MAX_SHARE`` of them carry it.
MIN_DOCS = 20
MAX_SHARE = 0.01
#: Of a document's words at least this share has to remain.
MIN_REMAINING = 0.5
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_lines(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD_CHAR))


def normalised_line(line: Column) -> Column:
    """A-Z lower, digits as 0, white space as one blank, none at the ends."""
    lower = F.translate(line, LETTERS[0] + "123456789", LETTERS[1] + "000000000")
    return F.trim(F.regexp_replace(lower, SPACE, " "))


def _beside(places: str, i: Column, x: Column) -> Column:
    """Whether the place before or after ``i`` has the same window."""
    before, after = F.get(F.col(places), i - 1)["h"], F.get(F.col(places), i + 1)["h"]
    return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))


def with_repeated_words(df: DataFrame, word_col: str) -> DataFrame:
    """Adds ``n_repeat_words``: words inside windows of five that the text has twice or more.

    Most texts repeat no window; those only count their windows. In the rest the
    windows are sorted by hash, so equal ones stand side by side, and the places
    found are sorted again to add up what their windows cover.
    """
    last = F.size("_h") - WINDOW
    windows = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    places = F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    starts = F.transform(F.filter("_p", lambda x, i: _beside("_p", i, x)), lambda x: x["i"])
    covered = F.aggregate(
        F.transform("_at", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - at, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return (
        df.withColumn("_h", F.transform(word_col, lambda w: F.xxhash64(w)))
        .withColumn("_g", windows)
        .withColumn("_p", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(places)))
        .withColumn("_at", F.when(F.col("_p").isNotNull(), F.sort_array(starts)))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
        .drop("_h", "_g", "_p", "_at")
    )


def base_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One narrow row per document: id, host, base rules, and its lines as (hash, words, times)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("_t"))
    d = d.withColumn("_w", words(F.col("_t"))).withColumn("_l", text_lines(F.col("_t")))
    bare = F.regexp_replace("_t", SPACE, "")
    d = d.select(
        "doc_id",
        "host",
        F.size("_w").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform(
            "_l",
            lambda line: F.struct(
                F.xxhash64(normalised_line(line)).alias("line"), F.size(words(line)).cast("long").alias("n")
            ),
        ).alias("lines"),
        "_w",
    )
    return with_repeated_words(d, "_w").drop("_w")


def frequent_lines(figures: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line, docs) of the lines above the limits, counted over all documents."""
    counts = (
        figures.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("docs"))
        .where(F.col("docs") > min_docs)
    )
    hosts = figures.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("host_docs"))
    return (
        counts.join(hosts, counts["host"].eqNullSafe(hosts["h"]))
        .where(F.col("docs") > F.col("host_docs") * max_share)
        .select("host", "line", "docs")
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_remaining: float = MIN_REMAINING,
) -> DataFrame:
    """The base figures, ``base_failed``, ``n_cut_lines``, ``n_cut_words``, ``cut_lines`` (hashes) and ``kept``.

    ``without_lines(text, cut_lines)`` is the text that remains.
    """
    figures = cut_lineage(base_figures(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()))
    frequent = cut_lineage(frequent_lines(figures, min_docs, max_share))
    lines = figures.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.n")
    cut = (
        lines.join(
            frequent.select(F.col("host").alias("h"), F.col("line").alias("l")),
            lines["host"].eqNullSafe(F.col("h")) & (lines["line"] == F.col("l")),
        )
        .groupBy("row")
        .agg(F.count("*").alias("n_cut_lines"), F.sum("n").alias("n_cut_words"), F.collect_set("line").alias("cut_lines"))
    )
    joined = figures.drop("lines").join(cut, "row", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    cut_words = F.coalesce("n_cut_words", F.lit(0).cast("long"))
    enough = F.col("n_words") - cut_words >= F.col("n_words") * min_remaining
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce("n_cut_lines", F.lit(0).cast("long")).alias("n_cut_lines"),
        cut_words.alias("n_cut_words"),
        F.coalesce("cut_lines", F.array().cast("array<bigint>")).alias("cut_lines"),
        (~failed & enough).alias("kept"),
    )


def without_lines(text: Column, cut_lines: Column) -> Column:
    """The text without the lines whose hash is in ``cut_lines``; lines without a word stay."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.array_join(
        F.filter(
            lines,
            lambda x: ~x.rlike(WORD_CHAR) | ~F.coalesce(F.array_contains(cut_lines, F.xxhash64(normalised_line(x))), F.lit(False)),
        ),
        "\n",
    )
