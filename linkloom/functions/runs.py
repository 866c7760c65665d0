"""Which runs of bytes of a set occur in texts, by Arrow batches.

A run is met by a code of its bytes, and a text gives codes of all its runs of the sizes asked for. All of
them are looked up in a bitmap, array by array, and only those it has leave the task. The bitmap
has two bits for each run of the set: a run of the set always passes, another with the odds that both are taken.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of texts looked at at once: the arrays made from them stay in a core's cache.
SLICE = 1 << 16
#: Bits of the map for a run, and the fewest and most bits of a map, as powers of two: 16 MB at most, however many runs.
BITS_A_RUN, LEAST, MOST = 64, 16, 27
#: Bits of one row that makes up the map.
BLOCK = 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _packed(octets: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, with zeros past the end."""
    padded = np.zeros(len(octets) + 7, np.uint8)
    padded[: len(octets)] = octets
    return np.ascontiguousarray(np.ndarray((len(octets),), "<u8", padded, strides=(1,)))


def _codes(packed: np.ndarray, size: int) -> np.ndarray:
    """A code of the ``size`` bytes from each place on that has so many."""
    count = max(len(packed) - size + 1, 0)
    code = packed[:count] & np.uint64((1 << 8 * min(size, 8)) - 1)
    code += np.uint64(size << 56 & (1 << 64) - 1 if size < 8 else 0)
    code *= _MIX
    for at in [*range(8, size - 8, 8), size - 8] if size > 8 else []:
        code ^= code >> np.uint64(32)
        code ^= packed[at : at + count]
        code *= _MIX
    return code


def _octets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    plain = texts.cast(pa.large_binary())
    bounds = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    held = plain.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8), bounds


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def runs_met(texts: pa.Array, sizes: list[int], bits: np.ndarray) -> pa.Array:
    """The distinct codes of each text's runs that the map has."""
    octets, bounds = _octets(texts)
    power = np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    first, last = (int(bounds[0]), int(bounds[-1])) if len(texts) else (0, 0)
    for begin in range(first, last, SLICE):
        packed = _packed(octets[begin : min(begin + SLICE + sizes[-1] - 1, last)])
        for size in sizes:
            code = _codes(packed, size)[:SLICE]
            # eight bits at once first, then the two of the code
            place = np.flatnonzero(bits[code >> (power + np.uint64(3))])
            code = code[place]
            kept = _is_set(bits, code >> power)
            place, code = place[kept], code[kept]
            kept = _is_set(bits, (code ^ code >> np.uint64(32)) & np.uint64(8 * len(bits) - 1))
            place, code = place[kept] + begin, code[kept]
            row = np.searchsorted(bounds, place, "right") - 1
            inside = place + size <= bounds[row + 1]  # others go on into the next text
            rows.append(row[inside])
            codes.append(code[inside])
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    row, code = row[new], code[new]
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code.view(np.int64)))


def whole_codes(texts: pa.Array) -> pa.Array:
    """The code of each text as one run; texts that are not empty."""
    octets, bounds = _octets(texts)
    codes = np.zeros(len(texts), np.uint64)
    lengths = np.diff(bounds)
    for size in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == size)
        spans = octets[bounds[at][:, None] + np.arange(size)].reshape(-1)
        codes[at] = _codes(_packed(spans), size)[::size]
    return pa.array(codes.view(np.int64))


def with_code(runs: DataFrame, run: str, code: str) -> DataFrame:
    """``runs`` with the code of the run."""
    return runs.withColumn(code, F.arrow_udf(whole_codes, "bigint")(F.col(run)))


def bitmap(runs: DataFrame, code: str) -> np.ndarray:
    """The map of all codes of a written table, put together map-side: at most ``2**MOST`` bits come to the driver."""
    power = min(max((BITS_A_RUN * max(runs.count(), 1) - 1).bit_length(), LEAST), MOST)
    both = F.array(
        F.shiftrightunsigned(code, 64 - power),
        F.col(code).bitwiseXOR(F.shiftrightunsigned(code, 32)).bitwiseAND(F.lit((1 << power) - 1)),
    )
    at = F.col("at")
    blocks = (
        runs.select(F.explode_outer(both).alias("at"))
        .groupBy(F.shiftright(at, BLOCK).alias("block"))
        .agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << BLOCK) - 1))).alias("bits"))
    )
    whole = np.zeros(1 << power - 3, np.uint8)
    for row in blocks.collect():
        begin = row["block"] << BLOCK - 3
        whole[begin : begin + (1 << BLOCK - 3)] = np.frombuffer(row["bits"], np.uint8)
    return whole


def codes_met(text: Column, sizes: list[int], bits: np.ndarray, context) -> Column:
    """The distinct codes of the text's runs of ``sizes`` bytes that the map has, as an array; the map is sent once."""
    sizes = sorted(sizes)
    carried = context.broadcast(bits)

    def met(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = carried.value
        for texts in batches:
            yield runs_met(texts, sizes, held)

    return F.arrow_udf(met, "array<bigint>")(text.cast("string"))


# executors need numpy and pyarrow; the functions here go with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
