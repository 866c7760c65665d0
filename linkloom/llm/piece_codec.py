"""Encoding and decoding by a sentencepiece model, with the source bytes of every piece.

A text is normalised through the model's compiled character map: at each place the
longest entry of the map that begins there is replaced, and each byte that comes out
records the byte of the text it came from. Blanks become the blank mark and, if the model
says so, one more is put in front. The normalised text is then cut into pieces by the
library, from a copy of the model without a normaliser, so what is encoded is exactly
what was aligned; the ends of each piece go back through the alignment to byte offsets of
the original text. Pieces of one character that is spelled in bytes share its span: it is
that of the last of them, and the others are empty at its start.

Where no entry of the vocabulary has a blank mark after another character, a normalised
text may be cut before each run of blank marks, and the pieces of the parts are those of
the text. A worker keeps what it has found for parts it has seen, up to a fixed number of
them, and asks the library for the rest. Other models are encoded and decoded whole.

How it runs: one narrow pass; nothing is shuffled. Long texts go in small groups, so what
a task holds does not follow its partition.

Defined results: a null text is an empty one and has no pieces. Repeated rows, null ids and
empty tables need no care; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import ready_for_python
from linkloom.llm.pieces import Remembered, once

#: Parts of texts a worker remembers; about 250 MB.
REMEMBERED = 1_000_000
#: Bytes of text whose parts are held at once.
GROUP_BYTES = 500_000
BLANK = "▁"
_MARK = BLANK.encode()
_PARTS = re.compile(f"{BLANK}+[^{BLANK}]*")
_SPACE = 0x20
_USER_DEFINED = 4


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, the field as written) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        start = at
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value, data[start:at]


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes, then the replacements.

    The layout is that of the public trie library the model format uses: 32-bit units
    with a label, an offset to the children, and a mark for the end of an entry.
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4) if size else np.zeros(0, "<u4")
        self.nodes = self.units.tolist()
        self.replacements = compiled[4 + size :]
        #: pairs of first bytes that some entry may begin with
        self.begins = np.zeros((256, 256), dtype=bool)
        if size:
            root = self._offset(self.nodes[0])
            for first in range(1, 256):
                node = root ^ first
                if node >= len(self.nodes) or self._label(self.nodes[node]) != first:
                    continue
                below = node ^ self._offset(self.nodes[node])
                self.begins[first] = self._ends(self.nodes[node])
                seconds = np.arange(256, dtype=np.int64) ^ below
                inside = seconds < len(self.nodes)
                labels = self.units[seconds[inside]] & np.uint32(0x800000FF)
                self.begins[first, np.flatnonzero(inside)[labels == np.flatnonzero(inside)]] = True

    @staticmethod
    def _label(unit: int) -> int:
        return unit & 0x800000FF

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    @staticmethod
    def _ends(unit: int) -> bool:
        return bool(unit & 0x100)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length and replacement of the longest entry that begins at ``at``; length 0 if none does."""
        nodes, found, value = self.nodes, 0, 0
        if not nodes:
            return 0, b""
        node = self._offset(nodes[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = nodes[node] if node < len(nodes) else 0
            if self._label(unit) != data[k]:
                break
            node ^= self._offset(unit)
            if self._ends(unit):
                found, value = k + 1 - at, nodes[node] & 0x7FFFFFFF
        if not found:
            return 0, b""
        return found, self.replacements[value : self.replacements.index(b"\0", value)]

    def places(self, data: np.ndarray) -> np.ndarray:
        """Places at which an entry may begin, by their first two bytes."""
        if not len(self.units) or not len(data):
            return np.zeros(0, dtype=np.int64)
        following = np.append(data[1:], 0)
        return np.flatnonzero(self.begins[data, following])


class Normaliser:
    """What a model's normaliser does, with the source of each byte that comes out."""

    def __init__(self, model: bytes):
        spec, trainer, symbols = b"", b"", []
        for number, value, _ in message_fields(model):
            if number == 1:
                piece = {n: v for n, v, _ in message_fields(value)}
                if piece.get(3) == _USER_DEFINED:
                    symbols.append(piece[1])
            elif number == 2:
                trainer = value
            elif number == 3:
                spec = value
        given = {n: v for n, v, _ in message_fields(spec)}
        self.map = CharacterMap(given.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(given.get(n, 1)) for n in (3, 4, 5))
        self.suffix = bool({n: v for n, v, _ in message_fields(trainer)}.get(24, 0))
        self.symbols = re.compile(b"|".join(map(re.escape, sorted(symbols, key=len, reverse=True)))) if symbols else None
        self.blank = _MARK if self.escape else b" "

    def _mapped(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the character map, the source of each, and where the unit of each begins."""
        given = np.frombuffer(data, dtype=np.uint8)
        at = np.arange(len(given))
        own = np.maximum.accumulate(np.where((given & 0xC0) == 0x80, 0, at)) if len(given) else at
        places = self.map.places(given)
        places = places[own[places] == places]
        fixed = {}
        if self.symbols:
            fixed = {m.start(): m.group() for m in self.symbols.finditer(data)}
            places = np.union1d(places, np.fromiter(fixed, dtype=np.int64, count=len(fixed)))
        if not len(places):
            return given, own, own
        out, source, unit, size, here = [], [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            if b > a:
                out.append(given[a:b])
                source.append(own[a:b])
                unit.append(own[a:b] - a + size)
                size += b - a

        for place in places.tolist():
            if place < here:
                continue
            length, new = (len(fixed[place]), fixed[place]) if place in fixed else self.map.longest(data, place)
            if not length:
                continue
            keep(here, place)
            out.append(np.frombuffer(new, dtype=np.uint8))
            source.append(np.full(len(new), place))
            unit.append(np.full(len(new), size))
            size, here = size + len(new), place + length
        keep(here, len(given))
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate([empty.astype(np.uint8), *out]), np.concatenate([empty, *source]), np.concatenate([empty, *unit])

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end an offset of ``data``."""
        if not data:
            return b"", np.zeros(1, dtype=np.int64)
        out, source, unit = self._mapped(data)
        end, first = len(data), 0
        if self.squeeze:
            space = out == _SPACE
            # blanks that lead their unit go if a blank, or nothing, comes before the unit
            before = np.where(unit == 0, True, space[np.maximum(unit - 1, 0)]) if len(out) else space
            breaks = np.maximum.accumulate(np.where(space, -1, np.arange(len(out)))) if len(out) else unit
            keep = ~(space & before & (breaks < unit))
            alone = space & (unit == np.arange(len(out))) & (np.append(unit[1:], len(out)) != unit)
            content = np.flatnonzero(~alone)
            if not len(content):
                return b"", np.zeros(1, dtype=np.int64)
            first = int(source[content[0]])
            out, source = out[keep], source[keep]
        if self.escape and (out == _SPACE).any():
            times = np.where(out == _SPACE, 3, 1)
            wide = np.repeat(np.where(out == _SPACE, _MARK[0], out), times).astype(np.uint8)
            starts = (np.cumsum(times) - times)[out == _SPACE]
            wide[starts + 1], wide[starts + 2] = _MARK[1], _MARK[2]
            out, source = wide, np.repeat(source, times)
        text = out.tobytes()
        if self.prefix and not self.suffix:
            text, source = self.blank + text, np.concatenate([np.full(len(self.blank), first), source])
        if self.squeeze:
            while text.endswith(self.blank):
                text = text[: -len(self.blank)]
                end = int(source[len(text)])
            source = source[: len(text)]
        if self.prefix and self.suffix:
            text, source = text + self.blank, np.concatenate([source, np.full(len(self.blank), end)])
        return text, np.append(source, end)


def _without_normaliser(model: bytes) -> bytes:
    """The model with a normaliser that changes nothing."""
    plain = b"\x18\x00\x20\x00\x28\x00"  # no blank in front, none removed, none escaped
    kept = b"".join(raw for number, _, raw in message_fields(model) if number not in (3, 4))
    return kept + b"\x1a" + bytes([len(plain)]) + plain


class PieceCodec:
    """Ids, source spans and decoded texts as a sentencepiece model gives them, without begin and end ids."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=_without_normaliser(model))
        self.normalise = Normaliser(model)
        size = self.library.vocab_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        #: normalised bytes of each piece; -1 for the unknown one, which has no fixed length
        self.lengths = np.array([1 if self.library.is_byte(i) else -1 if self.library.is_unknown(i) else len(p.encode()) for i, p in enumerate(pieces)])
        self.separable = self.normalise.prefix and not self.normalise.suffix and not any(BLANK in p.lstrip(BLANK) for p in pieces)
        # a character outside the vocabulary is spelled in bytes, so parts have no unknown pieces that the whole would join
        spelled = sum(map(self.library.is_byte, range(size))) == 256
        self.separable = self.separable and spelled and self.normalise.escape and self._decodes_by_parts()
        self.digits = np.array([list(f"{i},".encode().ljust(len(str(size)) + 1, b"\0")) for i in range(size)], dtype=np.uint8)
        self.seen = Remembered(self._values, REMEMBERED)

    def _decodes_by_parts(self) -> bool:
        given = [f"{BLANK}a", f"{BLANK * 2}b", f"{BLANK}ﬁ¼", BLANK * 3, f"{BLANK}𝒳"]
        parts = [self.bare.encode(p) for p in given]
        return self.library.decode(list(chain.from_iterable(parts))) == " ".join(map(self.library.decode, parts))

    def _values(self, keys: list[str]) -> list[bytes | tuple[bytes, str]]:
        """Ids of each key, a part less its first blank mark, as 32-bit numbers; with the decoded part where that is another text."""
        ids = self.bare.encode([BLANK + k for k in keys], num_threads=1) if keys else []
        texts = self.library.decode(ids) if ids else []
        return [
            array("I", own).tobytes() if text == key.replace(BLANK, " ") else (array("I", own).tobytes(), text)
            for key, own, text in zip(keys, ids, texts, strict=True)
        ]

    def _keys(self, text: str) -> list[str] | None:
        """The parts of a normalised text; None if it has to be encoded whole."""
        if not self.separable or not text.startswith(BLANK):
            return None if text else []
        if BLANK * 2 not in text and not text.endswith(BLANK):
            return text[1:].split(BLANK)
        return [p[1:] for p in _PARTS.findall(text)]

    def _piece_lengths(self, ids: np.ndarray, text: str) -> np.ndarray:
        lengths = self.lengths[ids]
        if (lengths < 0).any():
            own = self.bare.encode(text, out_type=str)
            lengths = np.where(lengths < 0, [len(p.encode()) for p in own], lengths)
        return lengths

    def written(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers with commas between."""
        rows = self.digits[ids]
        return rows[rows > 0].tobytes()[:-1]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """Of each text: ids, first and last byte (exclusive) of each in the text, and what the ids decode to."""
        normalised = [self.normalise(t.encode()) for t in texts]
        strings = [n.decode() for n, _ in normalised]
        keys = list(map(self._keys, strings))
        get = self.seen.group(list(chain.from_iterable(k for k in keys if k))).__getitem__
        for string, own, (_, source) in zip(strings, keys, normalised, strict=True):
            if own is None:
                whole = self.bare.encode(string)
                ids, decoded = np.array(whole, dtype="<u4"), self.library.decode(whole)
            else:
                values = list(map(get, own))
                try:
                    joined, decoded = b"".join(values), " ".join(own).replace(BLANK, " ")
                except TypeError:  # some part decodes to another text
                    joined = b"".join([v if isinstance(v, bytes) else v[0] for v in values])
                    decoded = " ".join([k.replace(BLANK, " ") if isinstance(v, bytes) else v[1] for k, v in zip(own, values, strict=True)])
                ids = np.frombuffer(joined, dtype=np.uint32)
            ends = source[np.cumsum(self._piece_lengths(ids, string))]
            begins = np.concatenate([source[:1], ends[:-1]]) if len(ids) else ends
            yield ids, begins, ends, decoded


def groups(texts: pa.Array, size: int = GROUP_BYTES) -> Iterator[list[str]]:
    """The texts of a batch in order, in groups of about ``size`` bytes; null is empty."""
    n = len(texts)
    if not n:
        return
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // size)) + 1), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield [t or "" for t in texts.slice(a, b - a).to_pylist()]


def _ready(docs: DataFrame, model_file: str, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    ready_for_python(docs.sparkSession)
    digest = hashlib.sha256(Path(model_file).read_bytes()).hexdigest()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), docs.schema[id_col].dataType.simpleString(), digest


def _codec(model_file: str, digest: str) -> PieceCodec:
    return once(("codec", digest), lambda: PieceCodec(Path(model_file).read_bytes()))


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, begins, ends: the pieces of each text and the bytes of the text each stands for.

    ``model_file`` is a path at which every executor has the model.
    """
    given, kind, digest = _ready(docs, model_file, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in groups(batch.column("text")):
                found = list(_codec(model_file, digest).encode(texts))
                offsets = np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([f[k] for f in found]).astype(t)))
                    for k, t in ((0, np.int32), (1, np.int64), (2, np.int64))
                ]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(texts)), *lists], ["doc_id", "ids", "begins", "ends"])
                done += len(texts)

    return given.mapInArrow(run, f"doc_id {kind}, ids array<int>, begins array<bigint>, ends array<bigint>")


def decode_ids(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text its ids decode to; null ids are none and decode to nothing."""
    ready_for_python(encoded.sparkSession)
    digest = hashlib.sha256(Path(model_file).read_bytes()).hexdigest()
    given = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            library = _codec(model_file, digest).library
            texts = [library.decode(ids) if ids else "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return given.mapInArrow(run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")


def piece_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`encode_pieces` and decoding give, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256,
    and n_spanned, the bytes of the text that the spans of its pieces cover."""
    given, kind, digest = _ready(docs, model_file, id_col, text_col)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_spanned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for texts in groups(batch.column("text")):
                codec = _codec(model_file, digest)
                for ids, begins, ends, decoded in codec.encode(texts):
                    rows.append((len(ids), hashlib.sha256(codec.written(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), int((ends - begins).sum())))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    return given.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_spanned long")
