"""Hard negatives: rows of another label that score almost as high as an anchor's positives.

Scores are integer inner products. Anchors are put into blocks of neighbours and each block gets a
spanning tree of short edges. A row is scored exactly at the root; at a child its score lies
within edge length times row norm of what it is at the parent, so an interval goes down the
tree, and a row is scored again only where its interval may matter: where it reaches the
lowest positive so far, or overlaps the window of scores of one of the anchor's positives. A
row that is passed over keeps its interval, which grows with each edge. Bounds carry a margin for
rounding, so the result is exact whatever the vectors; how many scores are saved depends on how near anchors are
to each other.

How it runs: anchors are a stated query set, met with all rows in blocks. They are sorted by
label and by a fixed direction, cut into blocks inside tasks, and go out in waves of at most ``WAVE_ANCHORS``
anchors and ``WAVE_NUMBERS`` numbers (64 MB), however many there are; a broadcast is released after its wave. A wave reads the rows twice, first
for positives, then, with the windows known, for negatives. A task keeps the best few of each anchor or window and
hands on only these, in as many tasks as a small multiple of the cores, so what is shuffled does not follow the rows.
Each wave's results are a written table.

Defined results: rows without label or vector, or with a null, NaN or infinite component take no part, nor do
rows whose integer vector has a squared norm of 2**62 or more (their scores need not fit a long). A
shorter vector counts as filled up with zeros. Every row counts by itself: of repeated rows each is an anchor, a positive and a
negative, and a repeat of an anchor is one of its other rows. A null id is no anchor, keeps its
label, and comes after all others of equal score. Equal scores and ids are ordered by label, then by the
order of the stored rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import cut_lineage, ready_for_python

BLOCK = 512
WAVE_ANCHORS = 16_384
WAVE_NUMBERS = 8 << 20
BATCH_ROWS = 4096
BATCH_NUMBERS = 1 << 20
#: Below this product of norms float64 holds every partial sum exactly.
EXACT = float(1 << 52)
NO_ID = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min


def prepared(rows: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """row, id, label, vec of the rows that take part, written."""
    x = F.col(vector_col)
    spoiled = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    norm = F.aggregate(F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double")), F.lit(0.0), lambda a, v: a + v * v)
    fitting = rows.where(label.isNotNull() & x.isNotNull() & ~spoiled).where(norm < float(1 << 62))
    return cut_lineage(
        fitting.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
            F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long")).alias("vec"),
        )
    )


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Vectors:
    """Integer vectors with what scoring takes."""

    def __init__(self, batch: pa.Table | pa.RecordBatch, dims: int):
        column = batch.column("vec")
        self.whole = matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, dims)
        self.near = self.whole.astype(np.float64)
        self.norms = np.sqrt((self.near * self.near).sum(axis=1))
        self.largest = float(self.norms.max(initial=0.0))
        self.row = batch.column("row").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column("row").to_numpy()
        self.label = np.asarray(batch.column("label"))
        ids = batch.column("id")
        self.id = np.asarray(ids.fill_null(NO_ID)) if ids.null_count else np.asarray(ids)
        self.without_id = np.asarray(ids.is_null()) if ids.null_count else np.zeros(len(self.row), dtype=bool)

    def scores(self, other: Vectors, at: int, among: np.ndarray | None = None) -> np.ndarray:
        """Exact scores with one vector of ``other``; as whole numbers of 64 bits."""
        if self.largest * float(other.norms[at]) < EXACT:
            left = self.near if among is None else self.near[among]
            return np.rint(left @ other.near[at]).astype(np.int64)
        left = self.whole if among is None else self.whole[among]
        return left @ other.whole[at]


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge length) of a minimum spanning tree from vector 0; parents come first in the order."""
    n = len(vectors)
    squares = (vectors * vectors).sum(axis=1)
    parent, best, left = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.ones(n, dtype=bool)
    order, at = np.zeros(n, dtype=np.int64), 0
    for k in range(n):
        order[k], left[at] = at, False
        to = squares + squares[at] - 2.0 * (vectors @ vectors[at])
        nearer = left & (to < best)
        best[nearer], parent[nearer] = to[nearer], at
        if k + 1 < n:
            at = int(np.argmin(np.where(left, best, np.inf)))
    edge = np.sqrt(((vectors - vectors[parent]) ** 2).sum(axis=1))
    return order, parent, edge


class Best:
    """The first few of many (score, id, label, row), by score downwards, then by id."""

    def __init__(self, count: int):
        self.count = count
        self.kept = np.zeros((5, 0), dtype=np.int64)

    def add(self, score: np.ndarray, rows: Vectors, among: np.ndarray) -> None:
        new = np.stack([score, rows.id[among], rows.label[among], rows.row[among], rows.without_id[among]])
        if len(score) > 4 * self.count:
            least = np.partition(score, len(score) - self.count)[len(score) - self.count]
            new = new[:, score >= least]
        both = np.concatenate([self.kept, new], axis=1)
        order = np.lexsort((both[3], both[2], both[1], both[4], -both[0]))[: self.count]
        self.kept = both[:, order]

    @property
    def least(self) -> int:
        """What a score has to reach to come in; ties may, by their ids."""
        return int(self.kept[0, -1]) if self.kept.shape[1] == self.count else NONE


class Block:
    """A block of anchors, walked down its spanning tree for each batch of rows."""

    def __init__(self, anchors: Vectors):
        self.anchors = anchors
        self.order, self.parent, self.edge = spanning_tree(anchors.near)
        self.scored = self.asked = 0

    def walk(self, rows: Vectors) -> Iterator[tuple[int, np.ndarray, np.ndarray, callable]]:
        """(anchor, lowest and highest each row's score may be, exact scores of chosen rows) down the tree."""
        n = len(rows.row)
        low, high = np.empty((len(self.order), n)), np.empty((len(self.order), n))
        for at in self.order.tolist():
            self.asked += n
            if at == self.order[0]:
                low[at] = high[at] = rows.scores(self.anchors, at)
                self.scored += n
            else:
                up = self.parent[at]
                # what 64-bit floats may lose on the way
                reach = self.edge[at] * rows.norms * (1 + 1e-9) + 1e-9 * rows.norms * (self.anchors.norms[at] + self.anchors.norms[up])
                np.subtract(low[up], reach, out=low[at])
                np.add(high[up], reach, out=high[at])

            def exact(among: np.ndarray, at: int = at) -> np.ndarray:
                found = rows.scores(self.anchors, at, among if len(among) < n else None)
                if at != self.order[0]:
                    self.scored += len(among)
                low[at, among] = high[at, among] = found
                return found

            yield at, low[at], high[at], exact


def _margin(x: np.ndarray | float) -> np.ndarray | float:
    """Slack of a 64-bit float that stands for a whole number."""
    return np.abs(x) * 2.0**-50


class Positives:
    """The first few rows of each anchor's own label."""

    def __init__(self, blocks: list[Block], count: int):
        self.blocks, self.best = blocks, [[Best(count) for _ in b.order] for b in blocks]

    def add(self, rows: Vectors) -> None:
        for block, best in zip(self.blocks, self.best, strict=True):
            for at, low, high, exact in block.walk(rows):
                own = np.flatnonzero((rows.label == block.anchors.label[at]) & (rows.row != block.anchors.row[at]))
                if not len(own):
                    continue
                count, least = best[at].count, best[at].least
                floor = float(least)
                if len(own) > count:  # as many rows reach at least this
                    floor = max(floor, float(np.partition(low[own], len(own) - count)[len(own) - count]))
                among = own[high[own] + _margin(high[own]) >= floor - _margin(floor)]
                if len(among):
                    best[at].add(exact(among), rows, among)

    def found(self) -> Iterator[tuple]:
        """(row of the anchor, its id and label, id, label and row of the positive, score)."""
        for block, best in zip(self.blocks, self.best, strict=True):
            for at, own in enumerate(best):
                a = block.anchors
                for score, id_, label, row, without in own.kept.T.tolist():
                    yield int(a.row[at]), int(a.id[at]), int(a.label[at]), None if without else id_, label, row, score


class Negatives:
    """The first few rows of other labels in each window of each anchor; a window is (slot, lowest, highest score)."""

    def __init__(self, blocks: list[Block], windows: dict[int, list[tuple[int, int, int]]], count: int):
        self.blocks = blocks
        self.windows = [[windows.get(int(r), []) for r in b.anchors.row] for b in blocks]
        self.best = [[[Best(count) for _ in w] for w in own] for own in self.windows]

    def add(self, rows: Vectors) -> None:
        for block, windows, best in zip(self.blocks, self.windows, self.best, strict=True):
            for at, low, high, exact in block.walk(rows):
                own = windows[at]
                if not own:
                    continue
                # where a window is full, a score has to reach the least of those in it
                floors = np.array([max(w[1], b.least) for w, b in zip(own, best[at], strict=True)], dtype=np.int64)
                tops = np.array([w[2] for w in own], dtype=np.int64)
                wanted = np.zeros(len(rows.row), dtype=bool)
                upper, lower = high + _margin(high), low - _margin(low)
                for floor, top in zip(floors.astype(np.float64), tops.astype(np.float64), strict=True):
                    wanted |= (upper >= floor - _margin(floor)) & (lower <= top + _margin(top))
                among = np.flatnonzero(wanted & (rows.label != block.anchors.label[at]))
                if not len(among):
                    continue
                scores = exact(among)
                for k in range(len(own)):
                    inside = (scores >= floors[k]) & (scores <= tops[k])
                    if inside.any():
                        best[at][k].add(scores[inside], rows, among[inside])

    def found(self) -> Iterator[tuple]:
        """(row of the anchor, slot, id, label and row of the negative, score)."""
        for block, windows, best in zip(self.blocks, self.windows, self.best, strict=True):
            for at, (own, kept) in enumerate(zip(windows, best, strict=True)):
                for (slot, _, _), few in zip(own, kept, strict=True):
                    for score, id_, label, row, without in few.kept.T.tolist():
                        yield int(block.anchors.row[at]), slot, None if without else id_, label, row, score


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Vectors]:
    """Rows in batches of a bounded size that is worth a walk."""
    limit = max(1, min(BATCH_ROWS, BATCH_NUMBERS // max(1, dims)))
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, len(batch), limit):
            part = batch.slice(at, limit)
            if held and sum(map(len, held)) + len(part) > limit:
                yield Vectors(pa.Table.from_batches(held), dims)
                held = []
            held.append(part)
    if held and sum(map(len, held)):
        yield Vectors(pa.Table.from_batches(held), dims)


def _blocks(anchors: DataFrame, count: int, dims: int) -> DataFrame:
    """The anchors with the block each belongs to: neighbours by label and by a fixed direction, written."""
    # signs that depend on the place alone
    along = F.aggregate(
        F.transform("vec", lambda v, i: v.cast("double") * F.when(F.xxhash64(i) % 2 == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda a, v: a + v
    )
    ordered = anchors.withColumn("along", along).sort("label", "along", "row").coalesce(max(1, math.ceil(count / (8 * BLOCK))))
    size = max(1, min(BLOCK, WAVE_NUMBERS // max(1, dims)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            block = (np.arange(len(batch)) + seen) // size
            seen += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*batch.schema.names, "part"])

    kind = "row long, id long, label long, vec array<bigint>"
    numbered = ordered.select("row", "id", "label", "vec").mapInArrow(number, f"{kind}, part long")
    return cut_lineage(numbered.withColumn("block", F.spark_partition_id().cast("long") * (1 << 32) + F.col("part")).drop("part"))


def _first(found: DataFrame, by: list[str], count: int) -> DataFrame:
    """The first ``count`` of each key, with ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("found_id").isNull(), "found_id", "found_label", "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(
    rows: DataFrame,
    id_col: str = "vec_id",
    label: Column | str = "label",
    vector_col: str = "embedding",
    every: int = 100,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides. The positives of an anchor are its first ``positives``
    other rows of the same label; of each, the first ``negatives`` rows of another label whose score is at
    least ``percent`` percent of the positive's and at most that are returned.
    """
    spark = rows.sparkSession
    ready_for_python(spark)
    table = prepared(rows, id_col, F.col(label) if isinstance(label, str) else label, vector_col, scale)
    dims = table.agg(F.max(F.size("vec"))).first()[0] or 0
    chosen = table.where(F.col("id") % every == 0)
    blocks = _blocks(chosen, chosen.count(), dims)
    sizes = blocks.groupBy("block").count().orderBy("block").collect()
    tasks = table.coalesce(4 * spark.sparkContext.defaultParallelism)
    most = max(1, min(WAVE_ANCHORS, WAVE_NUMBERS // max(1, dims)))
    waves: list[list[int]] = []
    held = most
    for block, size in sizes:
        if held + size > most:
            waves.append([])
            held = 0
        waves[-1].append(block)
        held += size
    found_kind = "anchor_row long, anchor_id long, anchor_label long, found_id long, found_label long, found_row long, score long"
    window_kind = "anchor_row long, slot int, found_id long, found_label long, found_row long, score long"
    results = []
    for wave in waves:
        packed = blocks.where(F.col("block").between(wave[0], wave[-1])).toArrow()
        sent = spark.sparkContext.broadcast(packed)

        def opened(sent=sent) -> list[Block]:
            table = sent.value
            of = np.asarray(table.column("block"))
            return [Block(Vectors(table.filter(pa.array(of == b)), dims)) for b in np.unique(of)]

        def search(batches: Iterator[pa.RecordBatch], opened=opened) -> Iterator[pa.RecordBatch]:
            work = None
            for vectors in _batches(batches, dims):
                work = work or Positives(opened(), positives)
                work.add(vectors)
            yield from _emitted(work, ["anchor_row", "anchor_id", "anchor_label", "found_id", "found_label", "found_row", "score"])

        near = _first(tasks.mapInArrow(search, found_kind), ["anchor_row"], positives)
        near = cut_lineage(near.withColumnRenamed("rank", "slot"))
        windows: dict[int, list[tuple[int, int, int]]] = {}
        # at most so many rows as the wave has anchors, times positives
        for r in near.where("score >= 0").select("anchor_row", "slot", "score").collect():
            windows.setdefault(r["anchor_row"], []).append((r["slot"], -(-percent * r["score"] // 100), r["score"]))
        sent_windows = spark.sparkContext.broadcast(windows)

        def choose(batches: Iterator[pa.RecordBatch], opened=opened, sent_windows=sent_windows) -> Iterator[pa.RecordBatch]:
            work = None
            for vectors in _batches(batches, dims):
                work = work or Negatives(opened(), sent_windows.value, negatives)
                work.add(vectors)
            names = ["anchor_row", "slot", "found_id", "found_label", "found_row", "score"]
            yield from _emitted(work, names)

        hard = _first(tasks.mapInArrow(choose, window_kind), ["anchor_row", "slot"], negatives)
        hard = hard.select("anchor_row", "slot", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
        pairs = near.select("anchor_row", "anchor_id", "slot", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
        results.append(
            cut_lineage(
                pairs.join(hard, ["anchor_row", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
            )
        )
        sent.destroy()
        sent_windows.destroy()
    if not results:
        kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], kind)
    whole = results[0]
    for part in results[1:]:
        whole = whole.unionByName(part)
    return whole


def _emitted(work: Positives | Negatives | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    if work is None:
        return
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = [pa.int32() if n == "slot" else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    for one in work.found():
        held.append(one)
        if len(held) == 10_000:
            yield batch()
            held = []
    if held:
        yield batch()
