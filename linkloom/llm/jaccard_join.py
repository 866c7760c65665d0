"""Self-join of documents on the Jaccard similarity of their word shingles, with adaptive prefixes.

Documents with the same shingle set are one class, represented by one of them. The
shingles of a class are put in one global order, rare ones first. Two sets that are
similar enough must share at least l of the first ``size - needed + l`` shingles, for
any l. Each class chooses its own l by estimated cost: a longer prefix meets more
lists but asks for more shared shingles before a pair is verified. A pair has to
share the smaller of the two l.

Pairs are made in three steps, because only connections are wanted:

1. every class meets only the least class of each list it is in. Those pairs are
   verified, and the links give groups, so thousands of near copies cost a pair or so
   each;
2. members of long lists meet a few more of their list, random ones, so that large
   groups of near copies which are not all similar to one of them become one group;
3. every two classes of *different* groups that share enough prefix shingles are
   verified. Lists that lie within one group are dropped before. No link between
   groups can be missed, and links within a group change nothing.

Before a pair is verified, or comes out of a join at all in step 3, the parity sketches
of its whole sets are compared: bit b of a sketch says whether an odd number of
shingles falls on b. Two sets differ in at least as many shingles as their sketches in
bits, so a pair whose sketches differ in more bits than the similarity allows is no
link. Verification reads the whole texts of both sides and compares the whole sets.

How it runs: the order comes from a table of counters (shingles fall on counters by
hash) that is filled over all documents. It has between 2**16 and 2**24 cells, so it
can be carried to every task; any order gives right results, a coarse one costs
time. Lists are never gathered: the least class is an aggregate, the rest are joins
of stored tables that adaptive execution may split.

Defined results: A-Z is lower-cased; a word is a run of ``[^\\x20\\x09-\\x0D]``. With
fewer words than a shingle has, the whole sequence is the only shingle. Without words
(null text, empty text) the set is empty and linked with nothing; the component of
such a document is its own id. Repeated rows are copies of each other. Null ids take
part; a component of null ids only has a null id. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm import textkit
from linkloom.llm.common import cut_lineage, ready_for_python
from linkloom.llm.components import components, joined

SHINGLE = 5
PERCENT = 80
LONGEST = 4
#: What comparing one shingle costs beside reading one entry of a list.
VERIFY_COST = 0.05
BLOCK_BITS = 14
#: Rounds that join groups through lists of at least ``LONG`` entries before pairs between groups are made.
ROUNDS, ORDERS, LONG = 2, 4, 16
#: 64-bit words of a sketch: beyond some 500 differing shingles it tells little, and pairs go on to verification.
SKETCH = [f"k{i}" for i in range(8)]
#: An odd multiplier, so that the bits of a sketch do not follow the cells of the counters.
_MIX = np.uint64(0xA24BAED4963EE407)


def _sets(batch_column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in textkit.slices(batch_column):
        words = textkit.Words(textkit.lowered(data), offsets)
        yield from textkit.shingle_sets(words, words.hashes(), n)


def needed(size: np.ndarray | int, percent: int):
    """The least overlap of a set of this size with any set similar enough."""
    return (percent * size + 99) // 100


def shingle_counters(docs: DataFrame, text_col: str, n: int, bits: int) -> np.ndarray:
    """For each of ``2**bits`` cells, how many documents have a shingle that falls on it."""
    shift = np.uint64(64 - bits)
    block = 1 << min(bits, BLOCK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for shingles in _sets(batch.column(0), n):
                # a set has few shingles beside the cells; add.at is right for repeated cells
                np.add.at(cells, (shingles >> shift).astype(np.int64), 1)
        for k in range(len(cells) // block):
            part = cells[k * block : (k + 1) * block]
            if part.any():
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([k], pa.int32()), "cells": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())}
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint32).astype(np.uint64)
                if k != now:
                    if now is not None:
                        yield _block(now, total)
                    now, total = k, cells
                else:
                    total = total + cells
        if now is not None:
            yield _block(now, total)

    def _block(k: int, total: np.ndarray) -> pa.RecordBatch:
        capped = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([k], pa.int32()), "cells": pa.array([zlib.compress(capped.tobytes(), 1)], pa.binary())}
        )

    schema = "block int, cells binary"
    merged = (
        docs.select(text_col)
        .mapInArrow(count, schema)
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(merge, schema)
    )
    counters = np.zeros(1 << bits, dtype=np.uint32)
    for row in merged.collect():  # at most 2**24 cells, whatever the input
        counters[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(zlib.decompress(row["cells"]), np.uint32)
    return counters


def _prefix(shingles: np.ndarray, counters: np.ndarray, shift: np.uint64, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set in global order, and the l it was chosen for."""
    size = len(shingles)
    least = needed(size, percent)
    common = counters[(shingles >> shift).astype(np.int64)]
    longest = min(LONGEST, least)
    first = min(size, size - least + longest)
    order = np.lexsort((shingles, common))[:first]
    lists = np.cumsum(common[order].astype(np.float64))
    best, ell = np.inf, 1
    for k in range(1, longest + 1):
        met = lists[size - least + k - 1]
        # at most met / k others can share k shingles
        cost = met + VERIFY_COST * size * met / k
        if cost < best:
            best, ell = cost, k
    return shingles[order[: size - least + ell]], ell


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """The parities of how many shingles fall on each bit, as words of 64 bits."""
    bits = 64 * len(SKETCH)
    mixed = shingles.view(np.uint64) * _MIX
    falls = (mixed >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(falls, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def class_rows(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, counters: np.ndarray, bits: int) -> DataFrame:
    """One narrow row per document: id, hash of the text, size, digest and sketch of the set, prefix and l."""
    carried = docs.sparkSession.sparkContext.broadcast(counters)
    shift = np.uint64(64 - bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, prefixes, ells = [], [], [], []
            sketches = np.zeros((batch.num_rows, len(SKETCH)), np.int64)
            for i, shingles in enumerate(_sets(batch.column("text"), n)):
                sizes.append(len(shingles))
                sketches[i] = _sketch(shingles)
                if not len(shingles):
                    digests.append(None), prefixes.append(None), ells.append(0)
                    continue
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                prefix, ell = _prefix(shingles, carried.value, shift, percent)
                prefixes.append(prefix.tobytes())
                ells.append(ell)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(prefixes, pa.binary()), pa.array(ells, pa.int32()), *[pa.array(k) for k in sketches.T],
                ],
                ["doc_id", "h", "n_shingles", "digest", "prefix", "ell", *SKETCH],
            )

    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, h long, n_shingles long, digest binary, prefix binary, ell int, " + ", ".join(f"{k} long" for k in SKETCH)
    return given.mapInArrow(rows, schema).withColumn("row", F.monotonically_increasing_id())


def _entries(classes: DataFrame) -> DataFrame:
    """(token, row, size, ell): an entry of each prefix shingle's list."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("prefix")]
            lengths = [len(t) for t in tokens]
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            spread = lambda name, k=lengths, b=batch: np.repeat(b.column(name).to_numpy(zero_copy_only=False), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), pa.array(spread("row")), pa.array(spread("n_shingles")), pa.array(spread("ell"))],
                ["token", "row", "size", "ell"],
            )

    return classes.select("prefix", "row", "n_shingles", "ell").mapInArrow(explode, "token long, row long, size long, ell int")


def _sketches(classes: DataFrame, row: str, size: str, mark: str) -> DataFrame:
    return classes.select(F.col("row").alias(row), F.col("n_shingles").alias(size), *[F.col(k).alias(mark + k) for k in SKETCH])


def _close(a: str, b: str, mark: str, percent: int) -> Column:
    """Sets of sizes a and b whose sketches (the second marked) do not differ in too many bits."""
    apart = sum((F.bit_count(F.col(k).bitwiseXOR(F.col(mark + k))) for k in SKETCH), F.lit(0))
    return apart * (100 + percent) <= (F.col(a) + F.col(b)) * (100 - percent)


def _hopeful(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out, stored."""
    met = pairs.join(_sketches(classes, "a", "_size_a", ""), "a").join(_sketches(classes, "b", "_size_b", "_"), "b")
    return cut_lineage(met.where(_close("_size_a", "_size_b", "_", percent)).select("a", "b"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose whole sets are similar enough, by their whole texts."""
    asked = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    keys = classes.join(asked, "row", "left_semi").select("row", F.col("doc_id").alias("i"), "h")
    given = docs.select(F.col(id_col).alias("d"), F.xxhash64(F.col(text_col)).alias("dh"), F.col(text_col).alias("text"))
    # rows repeated in the input would come twice; the text of one is enough
    texts = cut_lineage(
        keys.join(given, keys["i"].eqNullSafe(F.col("d")) & (keys["h"] == F.col("dh")))
        .select("row", "text")
        .dropDuplicates(["row"])
    )
    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(_sets(batch.column("ta"), n), _sets(batch.column("tb"), n), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, row, class_row, links, component_id and root of each document.

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets
    of n-word shingles; a component is what links reach, named by its least id. Several may
    have one name (null ids, an id with different texts); ``root``, a row number, tells them
    apart and is null without words. ``links`` counts the verified links of a document's class in the spanning set that was needed.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    bits = int(np.clip(np.ceil(np.log2(8 * max(docs.count(), 1))), 16, 24))
    counters = shingle_counters(docs, text_col, n, bits)
    rows = cut_lineage(class_rows(docs, id_col, text_col, n, percent, counters, bits))

    firsts = rows.where("digest is not null").groupBy("digest").agg(F.min("row").alias("row"))
    classes = cut_lineage(rows.join(firsts.select("row"), "row", "left_semi"))
    # spelled out from the prefixes each time: cheaper than a stored copy
    entries = _entries(classes)
    lists = entries.groupBy("token").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least < most")
    shared = cut_lineage(entries.join(lists.select("token", "least"), "token"))

    fits = _fits("size", "size2", percent)
    least = classes.select(F.col("row").alias("least"), F.col("n_shingles").alias("size2"), F.col("ell").alias("ell2"))
    star = (
        shared.where("row > least")
        .groupBy("least", "row")
        .agg(F.count("*").alias("common"), F.first("size").alias("size"), F.first("ell").alias("ell"))
        .join(least, "least")
        .where(fits & (F.col("common") >= F.least("ell", "ell2")))
        .select(F.col("least").alias("a"), F.col("row").alias("b"))
    )
    near = cut_lineage(_verified(_hopeful(star, classes, percent), classes, docs, id_col, text_col, n, percent))
    groups = cut_lineage(components(near))

    open_ = _between_groups(shared.drop("least"), groups)
    for round_ in range(ROUNDS):
        few = _hopeful(_some_pairs(open_, round_, percent), classes, percent)
        if few.isEmpty():
            continue
        found = cut_lineage(_verified(few, classes, docs, id_col, text_col, n, percent))
        if found.isEmpty():
            continue
        near = near.unionByName(found)
        groups = joined(groups, found)
        open_ = _between_groups(open_.drop("root"), groups)
    sketched = open_.join(classes.select("row", *SKETCH), "row")
    other = sketched.select(
        "token", F.col("row").alias("row2"), F.col("size").alias("size2"), F.col("ell").alias("ell2"), F.col("root").alias("root2"),
        *[F.col(k).alias(f"_{k}") for k in SKETCH],
    )
    apart = (F.col("row") < F.col("row2")) & (F.col("root") != F.col("root2"))
    cross = (
        sketched.join(other, "token")
        .where(apart & fits & _close("size", "size2", "_", percent))
        .groupBy("row", "row2")
        .agg(F.count("*").alias("common"), *[F.first(c).alias(c) for c in ("ell", "ell2", "size", "size2")])
        .where((F.col("common") >= F.least("ell", "ell2")) & _can_reach(percent))
        .select(F.col("row").alias("a"), F.col("row2").alias("b"))
    )
    cross = cut_lineage(cross)
    links, roots = near, groups
    if not cross.isEmpty():
        late = cut_lineage(_verified(cross, classes, docs, id_col, text_col, n, percent))
        links, roots = near.unionByName(late), joined(groups, late)
    degree = links.select(F.col("a").alias("row")).unionByName(links.select(F.col("b").alias("row"))).groupBy("row").agg(F.count("*").alias("links"))

    of_digest = classes.select("digest", F.col("row").alias("class_row")).join(
        roots.select(F.col("node").alias("class_row"), "root"), "class_row", "left"
    ).join(degree.withColumnRenamed("row", "class_row"), "class_row", "left").select(
        F.col("digest").alias("dg"), "class_row", F.coalesce("root", "class_row").alias("root"), F.coalesce("links", F.lit(0).cast("long")).alias("links")
    )
    narrow = rows.select("doc_id", "h", "n_shingles", "digest", "row")
    placed = cut_lineage(narrow.join(of_digest, F.col("digest") == F.col("dg"), "left").drop("digest", "dg"))
    names = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("name"))
    return placed.join(names, "root", "left").select(
        "doc_id", "h", "n_shingles", "row", "class_row", F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"), "root",
    )


def _between_groups(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """The entries with their groups, of those lists that are in more than one group."""
    known = cut_lineage(
        entries.join(groups.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    )
    mixed = known.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("token")
    return cut_lineage(known.join(mixed, "token"))


def _some_pairs(entries: DataFrame, round_: int, percent: int) -> DataFrame:
    """(a, b): members of long lists with a few others of the list, those that come first in a random order.

    There are ``ORDERS`` orders, a list uses one of them, so lists of the same documents
    agree on who comes first. This only joins groups early; it decides nothing.
    """
    order = F.xxhash64(F.lit(round_), F.pmod("token", F.lit(ORDERS)), "row")
    first = (
        entries.groupBy("token")
        .agg(F.count("*").alias("n"), F.min(F.struct(order.alias("o"), "row", "size", "ell", "root")).alias("f"))
        .where(F.col("n") >= LONG)
        .select("token", F.col("f.row").alias("row2"), F.col("f.size").alias("size2"), F.col("f.ell").alias("ell2"), F.col("f.root").alias("root2"))
    )
    return (
        entries.join(first, "token")
        .where((F.col("root") != F.col("root2")) & _fits("size", "size2", percent))
        .groupBy("row", "row2")
        .agg(F.count("*").alias("common"), F.first("ell").alias("ell"), F.first("ell2").alias("ell2"))
        .where(F.col("common") >= F.least("ell", "ell2"))
        .select(F.least("row", "row2").alias("a"), F.greatest("row", "row2").alias("b"))
        .distinct()
    )


def _can_reach(percent: int) -> Column:
    """Whether a pair that shares ``common`` prefix shingles can share as many as its two sizes ask for.

    Of the set whose prefix ends first, ``needed - l`` shingles lie beyond the prefix, and
    no more than these can be shared beside the ``common`` ones.
    """
    beyond = lambda size, ell: F.floor((F.col(size) * percent + 99) / 100) - F.col(ell)
    most = F.col("common") + F.greatest(beyond("size", "ell"), beyond("size2", "ell2"))
    return most * (100 + percent) >= (F.col("size") + F.col("size2")) * percent


def _fits(a: str, b: str, percent: int) -> Column:
    """Sets of these sizes can be similar enough."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the least id, one without an id last.

    Documents without words stay. Of rows that are the same in id and text one stays.
    """
    found = cut_lineage(jaccard_components(docs, id_col, text_col, n, percent))
    linked = found.where("root is not null")
    # of several rows with the least id (or none) the first row stays
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("f"))
    stay = cut_lineage(
        linked.join(first.select(F.col("f.row").alias("row")), "row", "left_semi").select(F.col("doc_id").alias("_i"), F.col("h").alias("_h"))
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumn("_row_hash", F.xxhash64(F.col(text_col)))
    kept = hashed.join(stay, F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_row_hash") == F.col("_h")), "left_semi")
    repeated = found.where("n_shingles > 0").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if repeated:
        kept = kept.dropDuplicates([id_col, "_row_hash"])
    empty = hashed.where(~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.unionByName(empty).select(*columns)
