"""Benchmark decontamination: documents that hold a benchmark item, also with edits.

A passage matches an item when turning one into the other takes at most ``MAX_EDITS``
(a share of the item's words) insertions, deletions and replacements of words.

Method: the walk of Chakraborty, Goldenberg and Koucky reads a word sequence with a
pointer that stays or advances by a random bit of (step, word). Two sequences at a
small edit distance are embedded at a small Hamming distance, because after an edit
the pointers fall into step again. Bit sampling takes ``SAMPLED`` places of the embedding
as a key; ``WALKS`` walks give as many tables, so near sequences meet in one of them with
high probability. The walk starts at every window of a document that may match; since
it only reads forward, one embedding serves items of all sizes. Items are also
embedded from their second to fourth word on, for passages whose first words differ.
What meets is verified: exact edit distance of the item to the best passage there,
after the same bound on word triples for that item alone.

How often walks meet depends on where the edits are, so they are not relied upon: d edits
spoil at most n d of an item's n-grams, so of any n d + 1 of them a passage that matches
holds one. The rarest of each item are a table too (triples; pairs or single words where
an item is too short for triples), and what holds one of them is verified as well. No
match can be missed.

Windows that cannot match are left out before the walks: a window needs at least the
triples that are not spoilt. That is exact, and items too short for it get every window.

How it runs: one narrow pass over the documents for each block of at most ``BLOCK``
items. A block's tables are carried to the tasks and have about ``BLOCK * WALKS * 4``
entries of 12 bytes at most, and a block is ended early when its items have more than
``BLOCK_WORDS`` words, whatever the benchmark's size; no document ever moves.

Defined results: text is lower-cased; words are runs of letters and digits, so marks
and white space do not matter. Null or wordless items match nothing; null or
wordless documents are clean. Repeated rows and items are each reported. Null ids are
reported as null. Empty tables give empty results (no items: all clean). Extra
columns pass through ``decontaminate`` and are not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from linkloom.llm import textkit
from linkloom.llm.common import ready_for_python

MAX_EDITS = 0.2
WALKS = 24
SAMPLED = 2
STARTS = 4
BLOCK = 20_000
BLOCK_WORDS = 4_000_000
FILTER_BITS = 22
PAD = np.uint64(0)


def allowed_edits(words: int) -> int:
    return int(words * MAX_EDITS + 1e-9)


def size_class(words: int) -> int:
    """Half of the bits of the largest power of two not above the size; its walk is 1.5 times that long."""
    return max(0, int(words).bit_length() - 1)


def steps_of(size: int) -> int:
    return max(2, (3 << size) // 2)


def _places(size: int) -> np.ndarray:
    """For each walk, the sampled places of the embedding, those near the start more often."""
    rng = np.random.default_rng(97 + size)
    return np.sort((rng.random((WALKS, SAMPLED)) ** 1.5 * steps_of(size)).astype(np.int64), axis=1)


def _walk_bits(step: int) -> np.ndarray:
    return textkit.mix(np.arange(1, WALKS + 1, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(step))


def walk_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size class, the keys (walk, window) of the windows from ``starts`` on."""
    length = max(steps_of(s) for s in sizes)
    places = {s: _places(s) for s in sizes}
    keys = {s: np.zeros((WALKS, len(starts)), np.uint64) for s in sizes}
    pointer = np.broadcast_to(starts, (WALKS, len(starts))).copy()
    for step in range(length):
        inside = pointer < ends
        symbol = np.where(inside, hashes[np.minimum(pointer, len(hashes) - 1)], PAD)
        for s in sizes:
            for walk, column in zip(*np.nonzero(places[s] == step), strict=True):
                keys[s][walk] = keys[s][walk] * np.uint64(0xD6E8FEB86659FD93) + symbol[walk] + np.uint64(column + 1)
        pointer += (textkit.mix(symbol ^ _walk_bits(step)[:, None]) >> np.uint64(63)).astype(np.int64)
    for s in sizes:
        keys[s] = textkit.mix(keys[s] ^ (np.arange(WALKS, dtype=np.uint64)[:, None] + np.uint64(s * WALKS + 1)))
    return keys


@dataclass
class Index:
    """Tables of a block of items."""

    ids: list
    words: list[np.ndarray]
    sizes: list[int]
    keys: np.ndarray
    items: np.ndarray
    longest: int
    #: word triples of the items, and how many a window needs; 0: every window is looked at
    triples: np.ndarray
    bitmap: np.ndarray
    least: int
    #: word triples of each item
    grams: list[np.ndarray]
    #: by n, sorted n-grams of which a match holds one, and their items
    rare: dict[int, tuple[np.ndarray, np.ndarray]]


def rare_grams(words: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each n, the n-grams of which any passage that matches an item holds at least one, and their items.

    An item of w words with d edits keeps ``w - n + 1 - n d`` of its n-grams at least; the
    largest n for which that is one or more is taken, and ``n d + 1`` places, rare ones first.
    """
    of_n: dict[int, list[int]] = {}
    for item, w in enumerate(words):
        d = allowed_edits(len(w))
        of_n.setdefault(next((n for n in (3, 2) if len(w) - n + 1 - n * d > 0), 1), []).append(item)
    tables = {}
    for n, members in of_n.items():
        grams = [textkit.ngrams(words[k], n) for k in members]
        known, counts = np.unique(np.concatenate([np.unique(g) for g in grams]), return_counts=True)
        keys = []
        for k, g in zip(members, grams, strict=True):
            order = np.lexsort((g, counts[np.searchsorted(known, g)]))
            keys.append(np.unique(g[order[: n * allowed_edits(len(words[k])) + 1]]))
        items = np.repeat(np.array(members, np.int32), [len(k) for k in keys])
        flat = np.concatenate(keys)
        by = np.argsort(flat, kind="stable")
        tables[n] = (flat[by], items[by])
    return tables


def build_index(ids: list, texts: list[str]) -> Index | None:
    column = pa.array([(t or "").lower() for t in texts], pa.string())
    words: list[np.ndarray] = []
    for _, _, data, offsets in textkit.slices(column):
        w = textkit.Words(data, offsets, textkit.NOT_ALNUM)
        hashes = w.hashes()
        words += [hashes[a:b].copy() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    keep = [k for k, w in enumerate(words) if len(w)]
    if not keep:
        return None
    ids, words = [ids[k] for k in keep], [words[k] for k in keep]
    sizes = sorted({size_class(len(w)) for w in words})
    found_keys, found_items = [], []
    for item, w in enumerate(words):
        size = size_class(len(w))
        starts = np.arange(min(STARTS, max(1, len(w) // 4)))
        keys = walk_keys(w, starts, np.full(len(starts), len(w)), [size])[size].ravel()
        found_keys.append(keys)
        found_items.append(np.full(len(keys), item, np.int32))
    keys, items = np.concatenate(found_keys), np.concatenate(found_items)
    order = np.argsort(keys, kind="stable")
    grams = [textkit.ngrams(w, 3) for w in words]
    triples = np.unique(np.concatenate(grams))
    bitmap = np.zeros(1 << FILTER_BITS, bool)
    bitmap[(triples >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    least = min(len(w) - 2 - 3 * allowed_edits(len(w)) for w in words)
    return Index(ids, words, sizes, keys[order], items[order], max(map(len, words)), triples, bitmap, max(0, least), grams, rare_grams(words))


def edit_distance(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Least word edits between an item and any part of a passage, and where that part ends."""
    n = len(passage)
    place = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for k, word in enumerate(item):
        step = np.empty(n + 1, np.int64)
        step[0] = k + 1
        np.minimum(row[:-1] + (passage != word), row[1:] + 1, out=step[1:])
        row = np.minimum.accumulate(step - place) + place
    end = int(row.argmin())
    return int(row[end]), end


def matches(index: Index, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, edits, last word) of the items found in a slice of texts, each pair once."""
    n = len(hashes)
    if not n:
        return
    begin_of = np.repeat(first[:-1], np.diff(first))
    end_of = np.repeat(first[1:], np.diff(first))
    place = np.arange(n)
    grams = textkit.ngrams(hashes, 3)
    if index.least:
        hit = np.zeros(n + 1, np.int64)
        maybe = np.flatnonzero(index.bitmap[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] & (place[: len(grams)] + 3 <= end_of[: len(grams)]))
        at = np.minimum(np.searchsorted(index.triples, grams[maybe]), len(index.triples) - 1)
        sure = maybe[index.triples[at] == grams[maybe]]
        hit[sure + 1] = 1
        total = np.cumsum(hit)
        # an edited passage may be longer than its item
        reach = index.longest + allowed_edits(index.longest)
        near = total[np.minimum(place + reach, end_of)] - total[np.maximum(place - STARTS, begin_of)]
        starts = np.flatnonzero(near >= index.least)
    else:
        starts = place
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    met: dict[tuple[int, int], list[int]] = {}
    for part in np.array_split(starts, len(starts) // 4096 + 1):
        if not len(part):
            continue
        for keys in walk_keys(hashes, part, end_of[part], index.sizes).values():
            left = np.searchsorted(index.keys, keys, side="left")
            right = np.searchsorted(index.keys, keys, side="right")
            walks, windows = np.nonzero(left < right)
            for walk, window in zip(walks, windows, strict=True):
                start = int(part[window])
                for item in set(index.items[left[walk, window] : right[walk, window]].tolist()):
                    met.setdefault((int(text_of[start]), item), []).append(start)
    for size, (keys, items) in index.rare.items():
        here = grams if size == 3 else textkit.ngrams(hashes, size)
        at = np.flatnonzero(place[: len(here)] + size <= end_of[: len(here)])
        if size == 3:
            at = at[index.bitmap[(here[at] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
        left, right = np.searchsorted(keys, here[at], side="left"), np.searchsorted(keys, here[at], side="right")
        for k in np.flatnonzero(left < right):
            where = int(at[k])
            text = int(text_of[where])
            for item in items[left[k] : right[k]].tolist():
                # a passage with this n-gram begins no earlier than this
                words = len(index.words[item])
                met.setdefault((text, item), []).extend((max(int(first[text]), where - words - allowed_edits(words)), where))
    for (text, item), found in sorted(met.items()):
        size = len(index.words[item])
        edits = allowed_edits(size)
        best = None
        for a, b in _joined(sorted(set(found)), size + edits):
            lo, hi = max(first[text], a - STARTS - edits), min(first[text + 1], b + size + edits)
            # the bound on shared triples again, now for this item
            least = size - 2 - 3 * edits
            if least > 0 and np.isin(index.grams[item], grams[lo : max(lo, hi - 2)]).sum() < least:
                continue
            distance, end = edit_distance(index.words[item], hashes[lo:hi])
            if distance <= edits and (best is None or distance < best[0]):
                best = (distance, int(lo + end - first[text]))
        if best:
            yield text, item, *best


def _joined(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """First and last of runs of starts that lie within ``gap`` of each other."""
    a = b = starts[0]
    for s in starts[1:]:
        if s - b > gap:
            yield a, b
            a = s
        b = s
    yield a, b


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[Index]:
    """The items in blocks; one block at a time is on the driver."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    ids, texts, words = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row["item_id"]), texts.append(row["text"])
        words += len(row["text"].split())
        if len(ids) == block or words >= BLOCK_WORDS:
            if index := build_index(ids, texts):
                yield index
            ids, texts, words = [], [], 0
    if ids and (index := build_index(ids, texts)):
        yield index


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in textkit.slices(column):
        words = textkit.Words(data, offsets, textkit.NOT_ALNUM)
        yield a, b, words.hashes(), words.first


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK,
) -> DataFrame:
    """doc_id, item_id, edits and last_word (place of the passage's end) of each pair found."""
    spark = docs.sparkSession
    ready_for_python(spark)
    given = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text"))
    kind, item_kind = given.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, edits long, last_word long"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    parts = [spark.createDataFrame([], schema)]
    for index in _item_blocks(benchmark, item_col, item_text_col, block):
        carried = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], carried=carried) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (a + text, carried.value.ids[item], edits, last)
                    for a, _, hashes, first in _slices(batch.column("text"))
                    for text, item, edits, last in matches(carried.value, hashes, first)
                ]
                at, items, edits, last = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(items, item_type),
                        pa.array(edits, pa.int64()), pa.array(last, pa.int64()),
                    ],
                    ["doc_id", "item_id", "edits", "last_word"],
                )

        parts.append(given.mapInArrow(find, schema))
    found = parts[-1] if len(parts) == 2 else parts[0]
    for part in parts[1:] if len(parts) > 2 else []:
        found = found.unionByName(part)
    return found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK,
) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    spark = docs.sparkSession
    ready_for_python(spark)
    kept = docs
    for index in _item_blocks(benchmark, item_col, item_text_col, block):
        carried = spark.sparkContext.broadcast(index)
        names = docs.columns

        def clean(batches: Iterator[pa.RecordBatch], carried=carried) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(len(batch), bool)
                for a, _, hashes, first in _slices(batch.column(len(names))):
                    for text, *_ in matches(carried.value, hashes, first):
                        good[a + text] = False
                yield batch.select(names).filter(pa.array(good))

        kept = kept.withColumn("__lower", F.lower(F.col(text_col))).mapInArrow(clean, docs.schema)
    return kept
