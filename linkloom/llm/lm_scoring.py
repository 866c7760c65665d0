"""Language-model scores by a weighted backoff automaton.

A state stands for the words read last, as far as the model knows them: the root for
none, others for one or two words. A state has arcs for the words that follow often
enough, with the log-probability of that word there, and one failure arc, with the
backoff weight, to the state of one word less. Reading a word means taking failure
arcs until there is an arc for it; the arc leads to the longest state that is a suffix
of what was read. A text is read once, left to right, and its log-probability is the sum
over all arcs taken. Absolute discounting smooths every state; the root has an arc for
every training token and shares add-one mass with unknown ones.

Which arcs exist: the root has all training tokens, with exact counts. Longer n-grams
are kept when they occur at least ``LEAST`` times in training, however large the corpus
is, so what is gathered grows with it. None of it is carried to the tasks or comes to the
driver: tables of n-grams and states are partitioned by hash, and each slice of documents
asks for its own.

How it runs: a first pass cuts documents into slices (about ``SLICE`` bytes) and writes,
for each, its distinct word hashes, its texts as indexes into them, and the training
counts. Then there is one exchange per order. Slices send distinct n-grams, with training
counts, to shards by hash; a shard adds up and answers each slice, and names for each kept
n-gram one slice that holds it. With the next exchange that slice adds the n-gram to the sums
of the state its arc starts from; states are added up and answered in the same way. Words and
pairs go first. A longer n-gram occurs no more often than either n-gram of one word less
inside it, so it is sent only if both are kept: the others cannot be. A key comes to a shard
once per slice at most, so frequent words are no hot keys. The last pass joins slices with
the answers and reads the texts. Each exchange removes its shuffle files when it is written.

Tokens: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, then one end token.

Defined results: a null or empty text is the end token alone. Repeated rows are texts
of their own. A null id is never held out and never learned from. Without training
documents every token is unknown. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import textkit
from linkloom.llm.common import crc_of_id, cut_lineage, ready_for_python

SLICE = 4 << 20
#: How often an n-gram of two or more words has to occur to be an arc.
LEAST = 2
ORDER = 3
DISCOUNT = 0.75
END = np.uint64(0x5DEECE66D1234567)
SHARD_BYTES = 16 << 20

SLICE_SCHEMA = (
    "slice string, ids array<long>, flags array<boolean>, lengths array<long>, n_train long, "
    "words binary, train binary, text binary"
)


def _zip(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, as the high ones are mostly zero."""
    return zlib.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def _unzip(blob, kind) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def slices_of(docs: DataFrame, id_col: str, text_col: str, learned: Column) -> DataFrame:
    """The documents as slices: ids, flags, token counts, distinct words, training counts, indexed text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        size, number, part = 0, 0, 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) else part
            for a, b, data, offsets in textkit.slices(batch.column("text")):
                words = textkit.Words(textkit.lowered(data), offsets)
                # an end token after the last word of each text
                tokens = np.insert(words.hashes(), words.first[1:], END)
                lengths = np.diff(words.first) + 1
                held.append([batch.column("doc_id").slice(a, b - a), batch.column("learned").slice(a, b - a), lengths, tokens])
                size += len(data)
                if size >= SLICE:
                    yield row(held, number, part)
                    held, size, number = [], 0, number + 1
        if held:
            yield row(held, number, part)

    def row(held: list[list], number: int, part: int) -> pa.RecordBatch:
        lengths = np.concatenate([h[2] for h in held])
        tokens = np.concatenate([h.pop() for h in held])
        learned_ = np.concatenate([np.asarray(h[1]) for h in held])
        words, _, text = _grouped(tokens)
        train = np.bincount(text[np.repeat(learned_, lengths)], minlength=len(words)).astype(np.uint32)
        ids = pa.chunked_array([h[0] for h in held]).combine_chunks().to_pylist()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f"{part}-{number}"]), pa.array([ids], pa.list_(pa.int64())), pa.array([learned_.tolist()], pa.list_(pa.bool_())),
                pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([int(train.sum())], pa.int64()),
                pa.array([_pack(words)], pa.binary()), pa.array([_zip(train)], pa.binary()), pa.array([_zip(text.astype(np.uint32))], pa.binary()),
            ],
            ["slice", "ids", "flags", "lengths", "n_train", "words", "train", "text"],
        )

    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learned, F.lit(False)).alias("learned"),
        F.spark_partition_id().alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return given.mapInArrow(cut, SLICE_SCHEMA)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as steps: the high bytes, mostly zero, compressed, the low ones as they are."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    high = zlib.compress(planes[5:].tobytes(), 1)
    return len(high).to_bytes(4, "little") + high + planes[:5].tobytes()


def _unpack(blob) -> np.ndarray:
    view = memoryview(blob)
    at = 4 + int.from_bytes(view[:4], "little")
    high = np.frombuffer(zlib.decompress(view[4:at]), np.uint8).reshape(3, -1)
    low = np.frombuffer(view[at:], np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(np.vstack([low, high]).T).view("<u8").ravel(), dtype=np.uint64)


def _runs(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, first, last) of sorted keys; a shard is a range of hashes."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    return [(s, a, b) for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if a < b]


ASKED = "slice string, level int, shard int, keys binary, first binary, second binary"
ANSWERED = "slice string, level int, shard int, first binary, second binary, distinct long"


def _asks(name: str, level: int, keys: np.ndarray, first: np.ndarray, second: np.ndarray | None, shards: int) -> Iterator[pa.RecordBatch]:
    """What a slice sends to the shards of a level: sorted keys with one or two numbers each."""
    runs = _runs(keys, shards)
    for at in range(0, len(runs), 64):
        some = runs[at : at + 64]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * len(some)), pa.array([level] * len(some), pa.int32()), pa.array([s for s, _, _ in some], pa.int32()),
                pa.array([_pack(keys[a:b]) for _, a, b in some], pa.binary()), pa.array([_zip(first[a:b]) for _, a, b in some], pa.binary()),
                pa.array([None if second is None else _zip(second[a:b]) for _, a, b in some], pa.binary()),
            ],
            ["slice", "level", "shard", "keys", "first", "second"],
        )


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as what was shuffled is written, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _exchanged(asked: DataFrame, shards: int) -> DataFrame:
    """Sums over all slices of what they sent, answered to each slice in the order of its keys.

    Of states (levels below 0) both numbers are added up. Of n-grams ``first`` is the count (0 for one that is
    not kept), ``second`` has the bits of those n-grams the slice is to add to their states;
    rows without a slice have the number of training words of a shard.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k, key in enumerate(zip(batch.column("level").to_pylist(), batch.column("shard").to_pylist(), strict=True)):
                if key != now and held:
                    yield totals(now, held)
                    held = []
                now = key
                second = batch.column("second")[k].as_buffer()
                held.append(
                    [
                        batch.column("slice")[k].as_py(), _unpack(batch.column("keys")[k].as_buffer()),
                        _unzip(batch.column("first")[k].as_buffer(), np.uint32), None if second is None else _unzip(second, np.uint64),
                    ]
                )
        if held:
            yield totals(now, held)

    def totals(key: tuple[int, int], held: list[list]) -> pa.RecordBatch:
        level, shard = key
        ends = np.cumsum([0, *(len(h[1]) for h in held)])
        _, at, place = _grouped(np.concatenate([h.pop(1) for h in held]))
        add = lambda k: _sums(place, np.concatenate([h[k] for h in held]), len(at))
        cuts = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        first, distinct = add(1), None
        if level < 0:
            both = add(2)
            second = [_zip(both[place[a:b]]) for a, b in cuts]
        else:
            distinct = int((first > 0).sum()) if level == 1 else 0
            if level > 1:
                first = np.where(first >= LEAST, first, np.uint64(0))
            own = np.zeros(len(place), bool)
            own[at[first > 0]] = True
            second = [zlib.compress(np.packbits(own[a:b]).tobytes(), 1) for a, b in cuts]
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([h[0] for h in held] + [None], pa.string()), pa.array([level] * (n + 1), pa.int32()), pa.array([shard] * (n + 1), pa.int32()),
                pa.array([*(_zip(first[place[a:b]]) for a, b in cuts), None], pa.binary()), pa.array([*second, None], pa.binary()),
                pa.array([None] * n + [distinct], pa.int64()),
            ],
            ["slice", "level", "shard", "first", "second", "distinct"],
        )

    dealt = asked.repartition(shards, "level", "shard").sortWithinPartitions("level", "shard")
    with _shuffles_removed(asked.sparkSession):
        return cut_lineage(dealt.mapInArrow(answer, ANSWERED))


def _sums(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by place; bincount adds in floats, which is exact up to 2**53."""
    return np.bincount(place, weights=values.astype(np.float64), minlength=n).astype(np.uint64)


def gram_keys(hashes: np.ndarray, doc: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each token; 0 where it would reach into the text before."""
    if order == 1:
        return hashes
    keys = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= order:
        keys[order - 1 :] = textkit.ngrams(hashes, order)
        keys[order - 1 :][doc[order - 1 :] != doc[: len(doc) - order + 1]] = 0
    return keys


def _tokens(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, indexes into them, flags and text number of each token of a slice."""
    words = _unpack(batch.column("words")[k].as_buffer())
    text = _unzip(batch.column("text")[k].as_buffer(), np.uint32)
    lengths = np.array(batch.column("lengths")[k].as_py(), np.int64)
    return words, text, np.array(batch.column("flags")[k].as_py(), bool), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and where each key is among them."""
    small = np.int32 if len(keys) < 1 << 31 else np.int64
    order = np.argsort(keys).astype(small)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), small)
    place[order] = np.cumsum(new, dtype=small) - small(1)
    return keys[new], order[new], place


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_grouped`` without 0, whose place is -1."""
    at = np.flatnonzero(keys)
    known, first, among = _grouped(keys[at])
    place = np.full(len(keys), -1, among.dtype)
    place[at] = among
    return known, at[first], place


def _holds(kept: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the n-gram at each token is one and is kept; ``kept`` is by place."""
    return np.append(kept, False)[place]


def _next_keys(hashes: np.ndarray, doc: np.ndarray, n: int, kept: np.ndarray) -> np.ndarray:
    """Keys of the n-grams whose two n-grams of one word less are kept (told for each token), 0 elsewhere.

    Words and pairs are asked together, so each pair has its key.
    """
    keys = gram_keys(hashes, doc, n)
    if n > 2:
        keys[~kept] = 0
        keys[1:][~kept[:-1]] = 0
    return keys


def _followed(doc: np.ndarray, place: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The tokens read from states: the n-gram before them occurs ``LEAST`` times at least."""
    at = np.flatnonzero(_holds(often >= LEAST, place)[:-1]) + 1
    return at[doc[at] == doc[at - 1]]


def _answer(answers: dict[int, list], level: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers a slice was given on a level, in the order of its keys; they are taken out."""
    given = answers.pop(level, [])
    first = [_unzip(a, np.uint64) for a, _ in given]
    if level < 0:
        second = [_unzip(b, np.uint64) for _, b in given]
    else:
        second = [np.unpackbits(_unzip(b, np.uint8), count=len(a)).astype(bool) for a, (_, b) in zip(first, given, strict=True)]
    none = (np.empty(0, np.uint64), np.empty(0, np.uint64 if level < 0 else bool))
    return np.concatenate([none[0], *first]), np.concatenate([none[1], *second])


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, dict]]:
    """Each slice with its answers by level (states at ``-n``), as they were written."""
    held: dict[int, list] = defaultdict(list)
    for batch in batches:
        for k, level in enumerate(batch.column("level").to_pylist()):
            if level is not None:
                # the answers of a slice come before it
                held[level].append((batch.column("first")[k].as_py(), batch.column("second")[k].as_py()))
                continue
            answers, held = held, defaultdict(list)
            yield batch, k, answers


def score_texts(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score and score of each document.

    ``learned`` tells which rows the model is made from.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    slices = cut_lineage(slices_of(docs, id_col, text_col, learned))
    tokens, read_ = slices.agg(
        F.coalesce(F.sum("n_train"), F.lit(0)),
        F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0)),
    ).first()
    # a shard holds its range of one order at a time; a slice has as many n-grams as tokens at most
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * read_ // SHARD_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                name = batch.column("slice")[k].as_py()
                words, text, flags, doc = _tokens(batch, k)
                yield from _asks(name, 1, words, _unzip(batch.column("train")[k].as_buffer(), np.uint32), None, shards)
                if order > 1:
                    yield from grams(name, gram_keys(words[text], doc, 2), 2, flags[doc])

    def grams(name: str, keys: np.ndarray, n: int, trained: np.ndarray) -> Iterator[pa.RecordBatch]:
        known, _, place = _distinct(keys)
        count = np.bincount(place[trained & (place >= 0)], minlength=len(known)).astype(np.uint32)
        yield from _asks(name, n, known, count, None, shards)

    counts = _exchanged(slices.select("slice", "words", "train", "text", "lengths", "flags").mapInArrow(ask, ASKED), shards)
    distinct = counts.where("slice is null").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]

    def add(top: int):
        """Asks for the states of ``top - 1`` words, and for the n-grams of ``top + 1`` if there are such."""

        def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, k, answers in _taken(batches):
                name = batch.column("slice")[k].as_py()
                words, text, flags, doc = _tokens(batch, k)
                hashes = words[text]
                known, place, often = words, text, _answer(answers, 1)[0]
                for n in range(2, top + 1):
                    shorter, shorter_at, of_shorter = known, place, often
                    keys = _next_keys(hashes, doc, n, _holds(often > 0, place))
                    known, first, place = _distinct(keys)
                    del keys
                    often, own = _answer(answers, n)
                wanted = np.zeros(len(shorter), bool)
                wanted[shorter_at[_followed(doc, shorter_at, of_shorter) - 1]] = True
                of = shorter_at[first[own] - 1]
                arcs = np.bincount(of, minlength=len(shorter)).astype(np.uint32)
                total = _sums(of, often[own], len(shorter))
                yield from _asks(name, -top, shorter[wanted], arcs[wanted], total[wanted], shards)
                del shorter, shorter_at, of_shorter, first, own, of, arcs, total, wanted
                if top < order:
                    yield from grams(name, _next_keys(hashes, doc, top + 1, _holds(often > 0, place)), top + 1, flags[doc])

        return asks

    def with_answers(answers: list[DataFrame]) -> DataFrame:
        rows = slices.select("slice", "ids", "flags", "lengths", "words", "text")
        for given in answers:
            rows = rows.unionByName(given.where("slice is not null").drop("distinct"), allowMissingColumns=True)
        by = ("slice", F.col("level").asc_nulls_last(), "shard")
        return rows.repartition("slice").sortWithinPartitions(*by)

    given = [counts]
    for n in range(2, order + 1):
        # the last pass alone asks for sums of states
        needed = [one.where("level > 0") for one in given]
        given.append(_exchanged(with_answers(needed).mapInArrow(add(n), ASKED), shards))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, answers in _taken(batches):
            words, text, flags, doc = _tokens(batch, k)
            hashes = words[text]
            documents = len(flags)
            summed = lambda values, d=doc, m=documents: np.bincount(d, weights=values, minlength=m)
            known, place, often = words, text, _answer(answers, 1)[0]
            by_word = (often.astype(np.float64) + 1.0) / (tokens + distinct + 1.0)
            now = by_word[text]
            n_known, base = summed(often[text] > 0).astype(np.int64), summed(np.log10(by_word)[text])
            for n in range(2, order + 1):
                shorter, shorter_at, of_shorter = known, place, often
                keys = _next_keys(hashes, doc, n, _holds(often > 0, place))
                known, _, place = _distinct(keys)
                del keys
                often = _answer(answers, n)[0]
                at = _followed(doc, shorter_at, of_shorter)
                state = shorter_at[at - 1]
                wanted = np.zeros(len(shorter), bool)
                wanted[state] = True
                arcs, total = np.zeros(len(shorter)), np.zeros(len(shorter))
                arcs[wanted], total[wanted] = _answer(answers, -n)
                # what a state's arcs leave, its failure arc carries
                seen = np.maximum(of_shorter.astype(np.float64), 1.0)
                backoff = np.where(arcs > 0, np.maximum(1.0 - (total - DISCOUNT * arcs) / seen, 1e-9), 1.0)
                del arcs, total, wanted
                now[at] *= backoff[state]
                found = np.append(often, np.uint64(0))[place[at]].astype(np.float64)
                taken = found > 0
                now[at[taken]] += (found[taken] - DISCOUNT) / seen[state[taken]]
                del shorter, shorter_at, of_shorter, at, state, found, taken, seen, backoff
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("ids")[k].as_py(), pa.int64()), pa.array(flags), pa.array(np.bincount(doc, minlength=documents)),
                    pa.array(n_known), pa.array(np.full(documents, tokens, np.int64)), pa.array(base), pa.array(summed(np.log10(now))),
                ],
                ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return with_answers(given).mapInArrow(
        read, "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def learned_from(doc_id: Column) -> Column:
    """Rows whose crc32 of the id modulo 7 is not 2; a null id is not learned from."""
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(7)) != 2, F.lit(False))
