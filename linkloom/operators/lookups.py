"""Lookups against tables of any size: processed seeds, keywords, host lists.

Finding which of many strings occur in a text is written as an equi-join, not as
a nested loop. Keywords are indexed under a run of characters that few keywords have, as short as that
allows: a text gives its runs of the few sizes in use, however many keywords of whatever
lengths there are, and meets only keywords whose run it has, which are then looked for in it. A bitmap of the index is asked
first, array by array, so runs that no keyword is indexed under are never rows. Hosts are met as a
whole: a text gives its substrings of the lengths hosts have, but only from the places where
a host may begin. Spark broadcasts an index when it is small enough by its own size
check and shuffles otherwise; indexes are written tables, so that size is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.binding import let
from linkloom.functions.runs import bitmap, codes_met, with_code
from linkloom.operators.skew import salted_join
from linkloom.session import cut_lineage


def _keyed(needles: DataFrame, column: str) -> tuple[DataFrame, list[int]]:
    """Distinct needles as keys, and their lengths."""
    keyed = needles.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_key", F.col(column))
    lengths = sorted(r[0] for r in keyed.select(F.length(column)).distinct().collect())
    return keyed, lengths


def _windows(text: Column, starts: Column, lengths: list[int]) -> Column:
    """The substrings of ``text`` of the given lengths from the given starts on, each once."""
    size = F.length(text)

    def of_length(n: Column) -> Column:
        fitting = F.filter(starts, lambda at: at + n <= size + 1)
        return F.transform(fitting, lambda at: F.substring(text, at, n))

    return F.array_distinct(F.flatten(F.transform(F.lit(lengths), of_length)))


def _places(text: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))


def _match(texts: DataFrame, keyed: DataFrame, candidates: Column) -> DataFrame:
    return texts.withColumn("_key", F.explode_outer(candidates)).join(keyed, "_key").drop("_key")


#: Sizes of runs. Runs of one size are few, so a longer list of keywords needs longer ones.
GRAMS = (3, 4, 6, 8, 12, 16, 24, 32, 48)
#: A run that at most this many keywords have is rare enough.
LISTED = 16


def _grams(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of characters of the given sizes."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def of_size(size: int) -> Column:
        def run(chars: Column) -> Column:
            return F.transform(
                F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (size - 1), F.lit(0))),
                lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, size)])
                if size <= 4 else F.array_join(F.slice(chars, i + 1, F.lit(size)), ""),
            )

        return let(chars, run)

    # runs of two sizes differ
    return F.concat(*[F.array_distinct(of_size(size)) for size in sizes])


def _runs(texts: DataFrame, column: str, sizes: list[int]) -> DataFrame:
    """Rows once per distinct run of their text."""
    return texts.withColumn("_gram", F.explode_outer(_grams(F.col(column), sizes))).where(F.col("_gram").isNotNull())


def gram_index(needles: DataFrame, column: str) -> DataFrame:
    """``(_gram, needle)``: each distinct, non-empty needle under a run of its characters, written.

    Runs have one of the sizes ``GRAMS``, or all of a shorter needle. The shortest size counts at which no more than
    ``LISTED`` needles have the needle's rarest run, so what a text meets does not grow with the list; where
    there is none, the rarest run of all. Ties take the run that the order of hashes gives, so needles that share
    all their runs still spread.
    """
    distinct = needles.select(column).where(F.col(column) != "").distinct()
    short = distinct.where(F.length(column) < GRAMS[0]).withColumn("_gram", F.col(column))
    spelled = cut_lineage(_runs(distinct, column, list(GRAMS)).unionByName(short))
    common = cut_lineage(spelled.groupBy("_gram").agg(F.count("*").alias("_n")))
    shortest = F.struct(F.length("_gram"), "_n", F.xxhash64("_gram", column))
    # a listed run has few rows, so only needles without one may meet hot runs
    listed = cut_lineage(
        spelled.join(common.where(F.col("_n") <= LISTED), "_gram").groupBy(column).agg(F.min_by("_gram", shortest).alias("_gram"))
    )
    others = spelled.join(listed.select(column), column, "left_anti")
    rarest = salted_join(others, common, "_gram").groupBy(column).agg(F.min_by("_gram", F.struct("_n", shortest)).alias("_gram"))
    return cut_lineage(listed.unionByName(rarest))


def keyword_matches(links: DataFrame, keywords: DataFrame, column: str = "raw", keyword: str = "keyword") -> DataFrame:
    """Each link once per keyword that its ``column`` contains, with the keyword.

    The empty keyword is in every link.
    """
    index, runs = _run_lookup(links, gram_index(keywords, keyword), column)
    everywhere = links.where(F.col(column).isNotNull()).withColumn(keyword, F.lit(""))
    with_empty = _has_empty(keywords, keyword)
    if runs is None:
        return everywhere if with_empty else everywhere.where(F.lit(False))
    found = _found(links, index, runs, column, keyword)
    return found.unionByName(everywhere) if with_empty else found


def _has_empty(keywords: DataFrame, keyword: str) -> bool:
    return not keywords.where(F.col(keyword) == "").isEmpty()


def _run_lookup(links: DataFrame, index: DataFrame, column: str) -> tuple[DataFrame, Column | None]:
    """The index by codes of its runs, and the codes among them that a link's text seems to have; None without any run."""
    sizes = [r[0] for r in index.select(F.octet_length("_gram")).distinct().collect()]
    if not sizes:
        return index, None
    coded = cut_lineage(with_code(index, "_gram", "_code").drop("_gram"))
    return coded, codes_met(F.col(column), sizes, bitmap(coded, "_code"), links.sparkSession.sparkContext)


def _found(links: DataFrame, index: DataFrame, runs: Column, column: str, keyword: str) -> DataFrame:
    """Links once per keyword of the index: what leaves a task are rows whose text seems to have a run of the index."""
    met = links.withColumn("_codes", runs).withColumn("_code", F.explode_outer("_codes")).drop("_codes")
    met = met.where(F.col("_code").isNotNull())
    # the test comes after the join; as a part of its condition it would be one more reason to plan a nested loop
    return salted_join(met, index, "_code").where(F.contains(column, F.col(keyword))).drop("_code")


def keyword_semi_join(links: DataFrame, keywords: DataFrame, column: str = "raw", keyword: str = "keyword") -> DataFrame:
    """Links whose ``column`` contains any keyword of the table; the keyword
    filter for lists too long for literals. No keywords keep everything."""
    if keywords.isEmpty():
        return links
    # the column comes first, as it does in a join on it
    links = links.select(column, *[c for c in links.columns if c != column])
    if _has_empty(keywords, keyword):
        return links.where(F.col(column).isNotNull())
    index, runs = _run_lookup(links, gram_index(keywords, keyword), column)
    if runs is None:
        return links.where(F.lit(False))
    # read twice, so what makes the links runs once; most links have no run of the index and stay where they are
    links = cut_lineage(links.where(F.size(runs) > 0))
    matched = _found(links.select(column).distinct(), index, runs, column, keyword)
    # both are written, so adaptive splitting applies to a text that many links have; salts would repeat each text
    return links.join(cut_lineage(matched.select(column).distinct()), column, "left_semi")


def scope_host_list(links: DataFrame, hosts: DataFrame, column: str = "url", host: str = "host") -> DataFrame:
    """Links in scope of any host of a table: the URL names the host right after
    a dot or a double slash."""
    keyed, lengths = _keyed(hosts.where(F.col(host) != ""), host)
    if not lengths:
        return links.where(F.lit(False))
    url = F.col(column)
    starts = F.filter(
        _places(url),
        lambda at: (F.substring(url, at - 1, F.lit(1)) == ".") & (at > 1)
        | (F.substring(url, at - 2, F.lit(2)) == "//") & (at > 2),
    )
    matched = _match(links.select(column).distinct(), keyed, _windows(url, starts, lengths))
    return salted_join(links, matched.select(column).distinct(), column, "left_semi")


def unprocessed_seeds(seeds: DataFrame, history: DataFrame) -> DataFrame:
    """Seeds the history does not have, each once.

    Repeats go before the anti-join, so both sides have unique keys and no key
    can be hot.
    """
    done = history.select(F.col("url").alias("seed")).distinct()
    return seeds.dropDuplicates(["seed"]).join(done, "seed", "left_anti")
