"""Vectorised words and shingles of whole texts, for use inside tasks.

Everything works on the UTF-8 bytes of an Arrow string column, many texts at a
time, in slices of bounded size, so a task's memory does not follow its partition.
A word is a run of ``[^\\x20\\x09-\\x0D]``; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators when only letters and digits make words; bytes of other scripts count as letters.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, kept between calls."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        # a single huge text gets its own table, which is not kept
        if n <= SLICE_BYTES + 1:
            _powers[str(base)] = have
    return have[:n]


class Words:
    """The words of a slice of texts, in order."""

    __slots__ = ("data", "starts", "ends", "doc", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR):
        self.data = data
        inside = ~separator[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        begins[cuts] = inside[cuts]
        self.starts = np.flatnonzero(begins)
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        last = cuts[cuts > 0] - 1
        stops[last] = inside[last]
        self.ends = np.flatnonzero(stops) + 1
        #: index of each text's first word, with the total at the end
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUE[self.data] * _power(_BASE, n), out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * _power(_INVERSE, n + 1)[self.starts])


def slices(column: pa.ChunkedArray | pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of row ranges with about ``size`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on; the caller drops those that run over a text's end."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + count]
    return mix(out)


def shingle_sets(words: Words, hashes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted set of n-word shingles of each text.

    With fewer words than ``n``, the whole sequence is the one shingle; a text
    without words has the empty set.
    """
    grams = ngrams(hashes, n)
    first = words.first
    for d in range(len(first) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield ngrams(hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.empty(0, dtype=np.uint64)
