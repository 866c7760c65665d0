"""Spelling variants: words that differ by one letter, grouped under the most frequent form.

The vocabulary goes into blocked Bloom filters, one shard for each word length. Every word
generates its edits of one letter, each edit is looked up in the shard of its own length, and
only edits that the filter has are shuffled, to an exact join with the vocabulary that
removes the false positives. Being near is mutual, so a word generates its deletions and the
replacements by later letters of the alphabet; the other half of the pairs are these turned round.

How it runs: words are counted with map-side reduction. Filters are tables of blocks of 4 KiB,
put together by native bitmap aggregates; they are broadcast in waves of at most
``WAVE_BLOCKS`` blocks (32 MB), however large the vocabulary, and each wave reads only words whose edits may
fall into its shards. A broadcast is released before the next. Edits are hashed as arrays, from
running sums over the letters, and are spelled out only where the filter has them. Words
beyond ``LONG`` letters share a shard, so there are few of them. A word has few neighbours, so no key of the
exact join is hot. Roots are found by doubling: forms are at least ``ratio`` times as frequent, which
bounds a chain, and with it the number of rounds, by the logarithm of the largest count.

Defined results: a null text has no words; a null id counts as an empty one. Repeated rows count
each. An empty table gives an empty result. A word with several near words of the largest count
takes the least of these in code-point order. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import cut_lineage, ready_for_python
from linkloom.llm.textkit import mix
from linkloom.operators.skew import salted_join

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of this length and more share a shard.
LONG = 64
BLOCK_BITS = 32768
BITS_PER_WORD = 16
HASHES = 6
WAVE_BLOCKS = 8192
#: Words whose edits one task looks up; the cost lies in the edits, not in the bytes of the words.
TASK_WORDS = 8192
#: Edits hashed at once.
CELLS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, slip: int | None = None
) -> DataFrame:
    """word, n: runs of letters with A-Z in lower case, of at least ``least_length`` letters and ``least_count`` occurrences.

    With ``slip``, a run loses a letter where ``slip`` divides the crc32 of ``<id>:<run>``; which
    one is that number modulo its length.
    """
    found = F.explode_outer(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), found.alias("run")).where("run is not null")
    if not slip:
        runs = runs.where(F.length("run") >= least_length)
    plain = F.lower("run") == F.col("run")
    words = runs.select("id", F.when(plain, F.col("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("word"))
    if slip:
        digest = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (F.col("digest") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        # a run may become shorter but never longer
        words = words.where(F.length("word") >= least_length).select("word", digest.alias("digest"))
        words = words.select(F.when(F.col("digest") % slip == 0, cut).otherwise(F.col("word")).alias("word"))
    words = words.where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Spelled:
    """Words of one length as a matrix of letters, with what hashing their edits takes."""

    def __init__(self, letters: np.ndarray):
        n, size = letters.shape
        self.letters = letters
        self.powers = np.ones(size + 1, dtype=np.uint64)
        np.multiply.accumulate(np.full(size, _BASE), out=self.powers[1:])
        self.values = letter_values(letters)
        self.prefix = np.zeros((n, size + 1), dtype=np.uint64)
        np.cumsum(self.values * self.powers[:size], axis=1, out=self.prefix[:, 1:])

    def hashes(self) -> np.ndarray:
        return mix(self.prefix[:, -1])

    def deletions(self, at: int) -> np.ndarray:
        """Hashes of the words without the letter at a place."""
        return mix(self.prefix[:, at] + (self.prefix[:, -1] - self.prefix[:, at + 1]) * _INVERSE)

    def replacements(self, at: int, alphabet: np.ndarray) -> np.ndarray:
        """Hashes, words by letters, of the words with each letter of the alphabet at a place."""
        change = letter_values(alphabet)[None, :] - self.values[:, at][:, None]
        return mix(self.prefix[:, -1][:, None] + change * self.powers[at])


def letter_values(letters: np.ndarray) -> np.ndarray:
    return mix(letters.astype(np.uint64) + np.uint64(1))


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, index of each word, its letters) for the lengths that occur."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        index = np.flatnonzero(sizes == size)
        yield int(size), index, flat[starts[index][:, None] + np.arange(size)]


def shard_of(size: int) -> int:
    return min(size, LONG)


class Layout:
    """Which blocks belong to which shard."""

    def __init__(self, counts: dict[int, int]):
        self.first: dict[int, int] = {}
        self.blocks: dict[int, int] = {}
        self.total = 0
        for shard in sorted(counts):
            self.first[shard] = self.total
            self.blocks[shard] = max(1, math.ceil(counts[shard] * BITS_PER_WORD / BLOCK_BITS))
            self.total += self.blocks[shard]

    def block(self, shard: int, hashes: np.ndarray) -> np.ndarray:
        return self.first[shard] + ((hashes >> np.uint64(32)) % np.uint64(self.blocks[shard])).astype(np.int64)

    def shards_in(self, first: int, stop: int) -> list[int]:
        return [s for s in self.first if self.first[s] < stop and self.first[s] + self.blocks[s] > first]


def bit(hashes: np.ndarray, k: int) -> np.ndarray:
    """Place of bit ``k`` inside its block; an odd step gives distinct places."""
    step = ((hashes >> np.uint64(15)) & np.uint64(BLOCK_BITS - 1)) | np.uint64(1)
    return ((hashes + np.uint64(k) * step) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


class Wave:
    """A run of blocks of the filters, as one array of bytes."""

    def __init__(self, layout: Layout, first: int, rows: list[tuple[int, bytes]], count: int):
        self.layout, self.first, self.stop = layout, first, first + count
        self.bytes = np.zeros((count, BLOCK_BITS // 8), dtype=np.uint8)
        for block, bits in rows:
            self.bytes[block - first] = np.frombuffer(bits, dtype=np.uint8)
        self.bytes = self.bytes.reshape(-1)

    def has(self, shard: int, hashes: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` (flat) of those the filter has, one bit after the other."""
        if shard not in self.layout.blocks:
            return np.zeros(0, dtype=np.int64)
        blocks = self.layout.block(shard, hashes)
        left = np.flatnonzero((blocks >= self.first) & (blocks < self.stop)) if self._partly(shard) else np.arange(len(hashes))
        base = (blocks - self.first) * (BLOCK_BITS // 8)
        for k in range(HASHES):
            at = bit(hashes[left], k)
            left = left[(self.bytes[base[left] + (at >> 3)] >> (at & 7)) & 1 == 1]
            if not len(left):
                break
        return left

    def _partly(self, shard: int) -> bool:
        start = self.layout.first[shard]
        return start < self.first or start + self.layout.blocks[shard] > self.stop

    def edits(self, words: list[str], alphabet: np.ndarray) -> Iterator[tuple[int, str]]:
        """(index of a word, an edit of it that the filter has)."""
        for size, index, letters in by_length(words):
            step = max(1, CELLS // max(1, len(alphabet)))
            for a in range(0, len(index), step):
                own, spelled = index[a : a + step], Spelled(letters[a : a + step])
                for at in range(size):
                    shard = shard_of(size - 1)
                    if at == 0:
                        fresh = np.arange(len(own))
                    else:  # of equal letters in a row only the first is deleted
                        fresh = np.flatnonzero(spelled.letters[:, at] != spelled.letters[:, at - 1])
                    for i in fresh[self.has(shard, spelled.deletions(at)[fresh])]:
                        word = words[own[i]]
                        yield own[i], word[:at] + word[at + 1 :]
                    flat = self.has(shard_of(size), spelled.replacements(at, alphabet).reshape(-1))
                    rows, columns = flat // len(alphabet), flat % len(alphabet)
                    later = alphabet[columns] > spelled.letters[rows, at]
                    for i, letter in zip(rows[later], alphabet[columns[later]], strict=True):
                        word = words[own[i]]
                        yield own[i], word[:at] + chr(letter) + word[at + 1 :]


def _filters(vocabulary: DataFrame, layout: Layout) -> DataFrame:
    """block, bits of all shards."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, letters in by_length(batch.column("word").to_pylist()):
                hashes = Spelled(letters).hashes()
                blocks = np.repeat(layout.block(shard_of(size), hashes), HASHES)
                bits = np.stack([bit(hashes, k) for k in range(HASHES)], axis=1).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(bits)], ["block", "bit"])

    placed = vocabulary.select("word").mapInArrow(places, "block long, bit long")
    return cut_lineage(placed.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")))


def near_candidates(vocabulary: DataFrame) -> DataFrame:
    """word, n, candidate: edits of the words of ``vocabulary`` (word, n, shard) that the filters have, each pair from one side."""
    spark = vocabulary.sparkSession
    ready_for_python(spark)
    counts = {r["shard"]: r["count"] for r in vocabulary.groupBy("shard").count().collect()}
    layout = Layout(counts)
    # at most the letters of the pattern
    alphabet = np.array(sorted(ord(r[0]) for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().collect() if r[0]), dtype=np.uint32)
    filters = _filters(vocabulary, layout)
    parts = []
    for first in range(0, layout.total, WAVE_BLOCKS):
        stop = min(layout.total, first + WAVE_BLOCKS)
        rows = [(r["block"], bytes(r["bits"])) for r in filters.where(F.col("block").between(first, stop - 1)).collect()]
        sent = spark.sparkContext.broadcast(Wave(layout, first, rows, stop - first))
        del rows

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, n = batch.column("word").to_pylist(), batch.column("n")
                found = list(sent.value.edits(words, alphabet))
                index = pa.array([i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("word").take(index), n.take(index), pa.array([e for _, e in found], pa.string())], ["word", "n", "candidate"]
                )

        inside = layout.shards_in(first, stop)
        asked = sorted({s for t in inside for s in (t, t + 1) if s <= LONG})
        tasks = math.ceil(sum(counts.get(s, 0) for s in asked) / TASK_WORDS)
        words = vocabulary.where(F.col("shard").isin(asked)).select("word", "n").repartition(max(1, tasks))
        parts.append(cut_lineage(words.mapInArrow(probe, "word string, n long, candidate string")))
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], "word string, n long, candidate string")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _roots(forms: DataFrame, rounds: int) -> DataFrame:
    """word, root of the words of ``forms`` (word, form): each round doubles how far a word has been followed."""
    link = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        ahead = link.select(F.col("word").alias("root"), F.col("root").alias("further"))
        link = cut_lineage(salted_join(link, ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return link


def spelling_variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``counts`` (word, n; each word once).

    ``form`` is the near word of the largest count (of these the least) if that is at least ``ratio`` times the
    word's, else null; ``root`` is the end of the chain of forms.
    """
    vocabulary = cut_lineage(counts.select("word", F.col("n").cast("long").alias("n"), F.least(F.length("word"), F.lit(LONG)).alias("shard")))
    known = vocabulary.select(F.col("word").alias("candidate"), F.col("n").alias("candidate_n"))
    pairs = near_candidates(vocabulary).join(known, "candidate")
    one = F.struct("word", "n", F.struct((-F.col("candidate_n")).alias("less"), F.col("candidate").alias("near")).alias("near"))
    other = F.struct(
        F.col("candidate").alias("word"), F.col("candidate_n").alias("n"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("near")).alias("near")
    )
    both = pairs.select(F.inline(F.array(one, other)))
    alone = vocabulary.select("word", "n", F.lit(None).cast("struct<less:bigint,near:string>").alias("near"))
    met = both.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("best"))
    better = -F.col("best.less") >= ratio * F.col("n")
    formed = cut_lineage(
        met.select("word", "n", "n_near", F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n"))
    )
    largest = formed.agg(F.max("n")).first()[0] or 1
    # a chain of k forms multiplies the count by ratio each time; without growth it may be as long as there are counts
    chain = math.log(largest) / math.log(ratio) + 1 if ratio > 1 else float(largest)
    roots = _roots(formed.where("form is not null"), max(0, math.ceil(math.log2(max(chain, 1.0)))))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
