"""Mixing sources to target weights by pivotal dependent rounding, by DataFrame functions only.

Each document of a source should be taken ``target / size of the source`` times. The
whole part of that is certain; the fraction is a probability. Pivotal rounding meets
two fractional documents at a time and moves mass between them, a random one of the
two directions chosen so that no expectation changes, until one of them is 0 or 1.
Mass is counted in words (probability times size), so what a source takes in all
stays the same at every step.

The rounding runs as a reduction tree: documents are dealt by hash into groups of
about ``GROUP``; a group rounds its documents one after the other and hands one
fractional residual on; residuals meet in groups again, until one per source is left
and is drawn. The error of a source is below one document. The number of levels is
the logarithm of the largest source to the base ``GROUP``; no task sees more than a
group at once, however large a source is.

Equal rows (same id, source and size) are rounded as one unit with a multiplicity,
so repeated rows cannot fill a group.

Defined results: a null text has size 0 and is taken 0 times; a null source is a
source, the last in order; rows with a null id are rounded like others. All random
numbers are hashes of seed, id, source and size, so a rerun gives the same rows. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import cut_lineage, uniform, words

GROUP = 64
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = 20240607
#: Equal documents whose rows one task makes at a time.
RUN = 4096


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, docs, target) for (source, size, n) rows.

    Targets share ``share`` of all sizes by weight, none above ``cap`` times its
    source, the excess dealt again by weight. That is the level at which capped
    sources and weighted rest add up; sorted by cap per weight, the capped ones are
    the first. One row per source goes through these windows, no document does.
    """
    totals = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units")
    )
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weighted = totals.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), place)).withColumn(
        "most", F.col("source_size") * F.lit(float(cap))
    )
    by_cap = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = weighted.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") >= F.col("most"))
    # a source after the first that is not capped takes the level of the first
    common = F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("w"), "level"))).over(everything)["level"]
    target = F.least(F.col("most"), F.coalesce(common * F.col("w"), F.col("most")))
    return leveled.select("source", "source_size", "units", target.alias("target"))


def _meet(acc: Column, x: Column, seed: int) -> Column:
    """Two fractional units: one becomes integral, the other is carried on."""
    up_most = F.least(acc["size"] * (1 - acc["p"]), x["size"] * x["p"])
    down_most = F.least(x["size"] * (1 - x["p"]), acc["size"] * acc["p"])
    up = uniform(F.lit(seed), acc["key"], x["key"]) * (up_most + down_most) < down_most
    acc_p = F.when(up, acc["p"] + up_most / acc["size"]).otherwise(acc["p"] - down_most / acc["size"])
    x_p = F.when(up, x["p"] - up_most / x["size"]).otherwise(x["p"] + down_most / x["size"])
    # what is settled is told by which bound was reached, not by comparing fractions
    acc_settled = F.when(up, acc["size"] * (1 - acc["p"]) <= x["size"] * x["p"]).otherwise(
        acc["size"] * acc["p"] <= x["size"] * (1 - x["p"])
    )
    clean = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    settled = F.when(acc_settled, F.struct(acc["unit"].alias("unit"), F.when(up, 1).otherwise(0).cast("long").alias("up"))).otherwise(
        F.struct(x["unit"].alias("unit"), F.when(up, 0).otherwise(1).cast("long").alias("up"))
    )
    return F.struct(
        F.when(acc_settled, x["key"]).otherwise(acc["key"]).alias("key"),
        F.when(acc_settled, x["unit"]).otherwise(acc["unit"]).alias("unit"),
        F.when(acc_settled, clean(x_p)).otherwise(clean(acc_p)).alias("p"),
        F.when(acc_settled, x["size"]).otherwise(acc["size"]).alias("size"),
        F.concat(acc["done"], F.array(settled)).alias("done"),
    )


_ROUNDED = "struct<key:bigint,unit:bigint,p:double,size:double,done:array<struct<unit:bigint,up:bigint>>>"


def pivotal_round(units: DataFrame, by: str, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(unit, up): 1 or 0 for each fractional unit.

    ``units`` has ``by``, unit (long, unique), key (a hash, the order of meeting),
    p (0 < p < 1), size (double, above 0) and n_by (units of its ``by`` value).
    """
    most = units.agg(F.max("n_by")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most, 2), group)))
    groups = F.ceil(F.col("n_by") / group).cast("long")
    now = units.select(by, "unit", "key", "p", "size", F.pmod(F.col("key"), groups).alias("bucket"))
    settled = None
    for level in range(levels):
        # large documents meet first, so that the one carried on at the end is a small one
        members = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "unit", "p", "size")))
        first = F.get("members", F.lit(0))
        start = F.struct(
            first["key"], first["unit"], first["p"], first["size"], F.array().cast("array<struct<unit:bigint,up:bigint>>")
        ).cast(_ROUNDED)
        rest = F.slice("members", 2, F.greatest(F.size("members") - 1, F.lit(0)))
        rounded = F.aggregate(rest, start, lambda acc, x: _meet(acc, x, seed + level).cast(_ROUNDED))
        stage = cut_lineage(
            now.groupBy(by, "bucket").agg(members.alias("members")).select(by, "bucket", rounded.alias("r"))
        )
        done = stage.select(F.explode("r.done").alias("d")).select("d.unit", "d.up")
        settled = done if settled is None else settled.unionByName(done)
        now = stage.select(
            by, F.col("r.unit").alias("unit"), F.col("r.key").alias("key"), F.col("r.p").alias("p"), F.col("r.size").alias("size"),
            F.floor(F.col("bucket") / group).cast("long").alias("bucket"),
        )
    # one residual per value of ``by`` is left
    last = now.select("unit", (uniform(F.lit(seed), F.lit("last"), F.col("key")) < F.col("p")).cast("long").alias("up"))
    return settled.unionByName(last)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken, one row per document."""
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size")
    )
    # written once, so that ids of units and the sizes are the same for all that follows
    units = cut_lineage(
        sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("unit", F.monotonically_increasing_id())
    )
    targets = source_targets(units, weights, share, cap)
    t = targets.select(F.col("source").alias("s"), "source_size", "units", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = cut_lineage(
        units.join(t, units["source"].eqNullSafe(t["s"]))
        .drop("s")
        .withColumn("mass", F.when(F.col("size") > 0, rate * F.col("n")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("mass").cast("long"))
        .withColumn("p", F.col("mass") - F.col("whole"))
    )
    fractional = placed.where("p > 0").select(
        "source", "unit", F.xxhash64(F.lit(seed), "doc_id", "source", "size").alias("key"), "p",
        (F.col("size") * 1.0).alias("size"), F.col("units").alias("n_by"),
    )
    rounded = placed.join(pivotal_round(fractional, "source", seed), "unit", "left")
    total = F.col("whole") + F.coalesce("up", F.lit(0).cast("long"))
    counted = cut_lineage(rounded.select("doc_id", "source", "size", "source_size", "target", "n", total.alias("total")))
    # rows of many equal documents are made in runs, each of which may go to another task
    starts = F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(RUN).cast("long"))
    run = F.sequence(F.col("start"), F.least(F.col("n"), F.col("start") + (RUN - 1)))
    many = counted.where(F.col("n") > RUN).withColumn("start", F.explode(starts)).repartition("doc_id", "source", "size", "start")
    few = counted.where(F.col("n") <= RUN).withColumn("start", F.lit(1).cast("long"))
    each = few.unionByName(many).withColumn("i", F.explode(run))
    copies = F.floor(F.col("total") / F.col("n")).cast("long") + (F.col("i") <= F.col("total") % F.col("n")).cast("long")
    return each.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it.

    Rows with the same id, source and size share their copies; they are dealt out by the
    mean, the rest to those that a hash of the whole row puts first.
    """
    taken = (
        mix(docs, id_col, text_col, source_col, **options)
        .groupBy("doc_id", "source", "size")
        .agg(F.sum("copies").alias("_all"), F.count("*").alias("_n"))
        .where("_all > 0")
        .select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_all", "_n")
    )
    taken = cut_lineage(taken)
    # a row is carried whole, so that no name of its columns can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select(row, F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.size(words(F.col(text_col))).cast("long").alias("_size"))
    # the side with one short row a key is hashed, so that rows with whole texts are not sorted
    joined = sized.join(
        taken.hint("shuffle_hash"),
        (F.col("_size") == F.col("_z")) & F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_s")),
    )
    alone = joined.where("_n = 1").select("row", F.col("_all").alias("_copies"))
    if taken.where("_n > 1").isEmpty():
        dealt = alone
    else:
        order = Window.partitionBy("_i", "_s", "_z").orderBy(F.xxhash64("row"))
        each = F.floor(F.col("_all") / F.col("_n")).cast("long") + (F.col("_place") <= F.col("_all") % F.col("_n")).cast("long")
        repeated = joined.where("_n > 1").withColumn("_place", F.row_number().over(order)).withColumn("_copies", each)
        dealt = alone.unionByName(repeated.where("_copies > 0").select("row", "_copies"))
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")
