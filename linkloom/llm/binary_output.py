"""Token ids in a binary file format with Simple-8b coding.

A word of 64 bits has a selector (4 bits) and 60 bits of equal fields: 1 field of 60
bits, 2 of 30, 3 of 20, 4 of 15, 5 of 12, 6 of 10, 7 of 8, 8 of 7, 10 of 6, 12 of 5,
15 of 4, 20 of 3, 30 of 2 or 60 of 1; two selectors stand for runs of 120 and 240
zeros. To keep most fields narrow, each block first numbers its distinct ids by
falling frequency; codes are these numbers plus 1. Code 0 is the escape: the id
stands in the block's list of escapes, in order. An id is escaped when it occurs once
in its block, so rare ids widen no word.

Blocks hold whole documents, about ``BLOCK_IDS`` ids, or one document if that is longer.
A file is a row of blocks; a row has the block's first document, its number of ids,
the table of ids, the words, the place of the word with every ``STRIDE``-th code, and
the escapes. Decoding is vectorised: the selectors of all words give the number
of fields of each, and each kind of selector is unpacked at once. With the offsets a
reader may begin in the middle of a block.

How it runs: documents are dealt by ranges of the id, sorted within a task, encoded
and written in order, one stream through each task. The starts of documents are sums
over the ranges before, one row per range. Reading goes file by file.

Defined results: a null text is an empty one. Each row is a document, also when ids
repeat; ids of any type that has an order stay as they are; equal ids are ordered by a hash of the text. A null id comes first. Equal rows
are interchangeable. Every document ends with the end id. Special strings inside a text
are handled as the library does by default. Texts of any length are encoded whole. An
empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import ready_for_python, scratch_path
from linkloom.llm.pieces import Remembered, once

END_ID = 2
BLOCK_IDS = 1 << 16
STRIDE = 1 << 10
#: Parts of texts a worker remembers.
REMEMBERED = 1_000_000
#: New parts that are given to the library as one text.
TOGETHER = 1024
#: White space that may hide how pieces are cut: any but single blanks and line breaks inside the text.
_UNEVEN = (
    r"[ \n][ \n]|^[ \n]|[ \n]$|"
    r"[\t\x0B\x0C\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
#: Fields of a word and bits of a field for the selectors 2 to 15; 0 and 1 are 240 and 120 zeros.
FIELDS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK_SCHEMA = (
    "range int, block int, ids array<{kind}>, hashes array<long>, lengths array<int>, n long, "
    "table binary, words binary, offsets binary, escapes binary"
)


def pack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of codes below 2**60, and the first code of each; each word takes the most codes that fit.

    The last word may have fewer codes than fields; the count of codes is kept outside.
    """
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = codes.astype(np.uint64)
    width = np.frexp(codes.astype(np.float64))[1].astype(np.int8)
    selector = np.full(n, len(FIELDS) - 1, dtype=np.int8)
    # from wide fields to narrow: where the next codes fit, the narrower fields win
    for s in range(len(FIELDS) - 2, -1, -1):
        # codes too wide before each place; beyond the end there are none
        wide = np.zeros(n + FIELDS[s] + 1, np.int32)
        np.cumsum(width > BITS[s], out=wide[1 : n + 1])
        wide[n + 1 :] = wide[n]
        fits = wide[FIELDS[s] : FIELDS[s] + n] == wide[:n]
        if not fits.any():
            # narrower fields hold more codes, so they cannot fit either
            break
        selector[fits] = s
    step = np.minimum(np.array(FIELDS)[selector], n - np.arange(n)).tolist()
    starts, at = [], 0
    add = starts.append
    while at < n:
        add(at)
        at += step[at]
    begin = np.array(starts)
    chosen = selector[begin]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.append(codes, np.zeros(240, np.uint64))
    for s in np.unique(chosen):
        if BITS[s]:
            mine = np.flatnonzero(chosen == s)
            fields = np.arange(FIELDS[s])
            # fields beyond the last code of the block are zeros of the padding
            values = padded[begin[mine][:, None] + fields]
            words[mine] |= np.bitwise_or.reduce(values << (fields * BITS[s]).astype(np.uint64), axis=1)
    return words, begin


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` codes of some words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(FIELDS)[selector]
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        if BITS[s]:
            mine = np.flatnonzero(selector == s)
            fields = np.arange(FIELDS[s])
            mask = np.uint64((1 << BITS[s]) - 1)
            values = (words[mine][:, None] >> (fields * BITS[s]).astype(np.uint64)) & mask
            out[begin[mine][:, None] + fields] = values
    return out[:n]


def encode_block(ids: np.ndarray) -> dict[str, bytes]:
    """Table, words, offsets and escapes of a block of ids."""
    if len(ids) and ids.max() < 1 << 20:
        counts = np.bincount(ids)
        distinct, inverse = np.arange(len(counts)), ids
    else:
        distinct, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    often = np.flatnonzero(counts > 1)
    ranked = often[np.argsort(-counts[often], kind="stable")]
    code_of = np.zeros(len(distinct), np.uint64)
    code_of[ranked] = np.arange(1, len(ranked) + 1)
    codes = code_of[inverse]
    words, begin = pack(codes)
    # the word in which every STRIDE-th code stands, and that word's first code
    places = np.arange(0, len(codes), STRIDE)
    word = np.searchsorted(begin, places, side="right") - 1
    offsets = np.stack([word, begin[word]], axis=1) if len(codes) else np.empty((0, 2))
    return {
        "table": distinct[ranked].astype("<u4").tobytes(),
        "words": words.astype("<u8").tobytes(),
        "offsets": offsets.astype("<u4").tobytes(),
        "escapes": ids[codes == 0].astype("<u4").tobytes(),
    }


def decode_block(n: int, table: bytes, words: bytes, offsets: bytes, escapes: bytes, start: int = 0) -> np.ndarray:
    """The ids of a block of ``n`` ids, from place ``start`` on.

    With a start, words before the stride that holds it are not unpacked.
    """
    data = np.frombuffer(words, "<u8")
    if start >= n:
        return np.empty(0, np.uint32)
    word, first = (int(x) for x in np.frombuffer(offsets, "<u4").reshape(-1, 2)[start // STRIDE])
    codes = unpack(data[word:], n - first)[start - first :].astype(np.int64)
    ids = np.empty(len(codes), np.uint32)
    plain = codes > 0
    ids[plain] = np.frombuffer(table, "<u4")[codes[plain] - 1]
    # escapes are in order, so the last ones belong to this part
    missing = int((~plain).sum())
    if missing:
        ids[~plain] = np.frombuffer(escapes, "<u4")[-missing:]
    return ids


class ByteEncoder:
    """Ids of whole texts as a byte-level BPE of the tokenizers library gives them.

    The library first cuts a text into pieces. A blank between two characters that are
    not white space always begins a piece, and a line break there is a piece of its own,
    so a text may be cut before them and its parts encoded apart. A worker keeps the ids
    of parts it has met; new ones are encoded many at a time as one text, whose ids are cut
    again before every id that begins with a blank or is a line break. Texts with other white
    space, with runs of it, or with a special string go to the library whole.
    """

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        blank, line = (self.library.encode(c, add_special_tokens=False).tokens for c in " \n")
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, number in vocabulary.items():
            self.begins[number] = len(blank) == 1 and (token.startswith(blank[0]) or [token] == line)
        self.seen = Remembered(self._ids, REMEMBERED)

    def _ids(self, parts: list[str]) -> list[bytes]:
        # a part that begins a line brings its line break; the others have lost a blank
        given = [p if p[:1] == "\n" else f" {p}" for p in parts]
        groups = [given[k : k + TOGETHER] for k in range(0, len(given), TOGETHER)]
        found: list[bytes] = []
        for group, e in zip(groups, self.library.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = (4 * np.flatnonzero(self.begins[ids])).tolist()
            if len(cuts) == len(group) and cuts[:1] == [0]:
                raw = ids.tobytes()
                found += [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
            else:
                found += self._apart(group)
        return found

    def _apart(self, given: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(given, add_special_tokens=False)]

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Little-endian 32-bit ids with the end id."""
        end = np.array([end_id], "<u4").tobytes()
        column = pa.array(texts, pa.large_string())
        whole = pc.or_(pc.match_substring_regex(column, _UNEVEN), pc.equal(column, ""))
        for special in self.special:
            whole = pc.or_(whole, pc.match_substring(column, special))
        pieces = pc.split_pattern(pc.replace_substring(column.filter(pc.invert(whole)), "\n", " \n"), " ")
        cut = iter(self._joined(pieces) if len(pieces) else ())
        return [(self._whole(t) if w else next(cut)) + end for t, w in zip(texts, whole.to_pylist(), strict=True)]

    def _joined(self, pieces: pa.ListArray) -> list[bytes]:
        """The ids of texts that are given as lists of their parts, none of them empty."""
        coded = pieces.flatten().dictionary_encode()
        names, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        bounds = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        # the first part of a text has no blank before it
        first = [names[k] for k in index[bounds[:-1]]]
        index[bounds[:-1]] = np.arange(len(names), len(names) + len(first))
        values = [*self.seen.each(names), *self._apart(first)]
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        start = np.cumsum(size) - size
        each = size[index]
        ends = np.cumsum(each)
        ids = np.frombuffer(b"".join(values), "<u4")
        raw = ids[np.repeat(start[index] - (ends - each), each) + np.arange(ends[-1])].tobytes()
        stops = [0, *(4 * ends[bounds[1:] - 1]).tolist()]
        return [raw[i:j] for i, j in zip(stops[:-1], stops[1:], strict=True)]


def write_ids(
    docs: DataFrame,
    out_dir: str,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    partitions: int | None = None,
) -> None:
    """Encode whole texts and write the blocks, in ascending order of ids over all files.

    ``tokenizer_file`` is a path at which every executor has the file.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    ordered = given.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("h")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, size, number = None, [], 0, 0
        for batch in batches:
            encoder = encoder or once(("bytes", tokenizer_file), lambda: ByteEncoder(tokenizer_file))
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "h", "range")]
            id_type = batch.column("doc_id").type
            for k in range(0, len(batch), 512):
                texts = batch.column("text").slice(k, 512).to_pylist()
                for j, ids in enumerate(encoder.encode(texts, end_id)):
                    held.append((*(c[k + j] for c in columns), ids))
                    size += len(ids)
                    if size >= 4 * BLOCK_IDS:
                        yield _block(held, number, id_type)
                        held, size, number = [], 0, number + 1
        if held:
            yield _block(held, number, id_type)

    ordered.withColumn("range", F.spark_partition_id()).mapInArrow(encode, BLOCK_SCHEMA.format(kind=kind)).write.parquet(out_dir)


def _block(held: list[tuple], number: int, id_type: pa.DataType) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(x[3] for x in held), "<u4")
    coded = encode_block(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([held[0][2]], pa.int32()), pa.array([number], pa.int32()),
            pa.array([[x[0] for x in held]], pa.list_(id_type)), pa.array([[x[1] for x in held]], pa.list_(pa.int64())),
            pa.array([[len(x[3]) // 4 for x in held]], pa.list_(pa.int32())), pa.array([len(ids)], pa.int64()),
            *(pa.array([coded[c]], pa.binary()) for c in ("table", "words", "offsets", "escapes")),
        ],
        ["range", "block", "ids", "hashes", "lengths", "n", "table", "words", "offsets", "escapes"],
    )


def read_ids(spark: SparkSession, out_dir: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids (little-endian bytes)."""
    ready_for_python(spark)
    blocks = spark.read.parquet(out_dir)
    # one row per range and block goes through the windows, no ids
    heads = blocks.groupBy("range").agg(F.sum("n").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = heads.select(F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("range_start"))
    inner = Window.partitionBy("range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.select("range", "block", "n")
        .withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0).cast("long")))
        .join(ranges, F.col("range") == F.col("r"))
        .select(F.col("range").alias("r"), F.col("block").alias("b"), (F.col("inner") + F.col("range_start")).alias("start"))
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                blob = lambda c, b=batch, i=k: b.column(c)[i].as_py()
                ids = decode_block(blob("n"), blob("table"), blob("words"), blob("offsets"), blob("escapes")).astype("<u4")
                lengths = np.array(blob("lengths"), np.int64)
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([blob("range")] * len(parts), pa.int32()), pa.array([blob("block")] * len(parts), pa.int32()),
                        batch.column("ids")[k].values, pa.array(ends - lengths), pa.array(lengths),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()), *([pa.array(parts, pa.binary())] if with_ids else []),
                    ],
                    ["range", "block", "doc_id", "at", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])],
                )

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    fields = [("range", "int"), ("block", "int"), ("doc_id", kind), ("at", "long"), ("n_tokens", "long"), ("ids_crc32", "long")]
    fields += [("ids", "binary")] if with_ids else []
    rows = blocks.drop("hashes").mapInArrow(decode, ", ".join(f"{n} {t}" for n, t in fields))
    placed = rows.join(starts, (F.col("range") == F.col("r")) & (F.col("block") == F.col("b")))
    return placed.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from written files."""
    path = scratch_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer_file, **options)
    return read_ids(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")
