"""SentencePiece BPE by a merge-type prefix table, without the sentencepiece library.

Byte-pair merging gives every prefix of a text one encoding, so each prefix has
one last token. The table of these is filled from left to right: an automaton
lists the tokens that end at a position, and the one that belongs there is the
one compatible with the last token of the prefix before it. Two neighbours are
compatible if merging their joined text would leave exactly the two. The ids are
then read from the table backwards. The work is linear in the text.

No piece holds the space mark after another character, and none holds a line
end, so texts are cut there first and each distinct unit is encoded once per
worker; a unit of any length is encoded whole.

Defined results. Null text counts as empty; empty text has the end id alone, and
decodes to the empty text. Repeated rows give repeated results, an empty table
none. Texts of any length are encoded whole. Characters outside the vocabulary
become byte pieces. ``encode``, ``decode`` and ``encoded`` keep other columns and
replace those of their output's names; ``digest`` ignores them.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
CACHE_UNITS = 300_000
CACHE_CHARS = 64
CACHE_PAIRS = 1_000_000


# --- model file -------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces and settings of a .model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        kinds = {kind for _, _, kind in self.pieces}
        if trainer.get(3) != BPE or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
            raise ValueError("only BPE models with byte fallback and without text normalisation are supported")


# --- codec ------------------------------------------------------------------


class PrefixTableCodec:
    """Encoder and decoder of one model."""

    def __init__(self, data: bytes):
        import ahocorasick

        model = Model(data)
        self.dummy_prefix = model.dummy_prefix
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        normal = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.end_id = next((i for i, (p, _, kind) in enumerate(model.pieces) if kind == CONTROL and p == "</s>"), None)
        unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)

        # Tokens by number: first the pieces, then characters that occur in pieces only.
        chars = {c for p in normal for c in p} - normal.keys()
        self.texts = [p if kind == NORMAL else "" for p, _, kind in model.pieces] + sorted(chars)
        self.numbers = {t: i for i, t in enumerate(self.texts) if t}
        self.foreign = len(self.texts)  # stands for any character in no piece
        levels = {s: n for n, s in enumerate(sorted({model.pieces[i][1] for p, i in normal.items() if len(p) > 1}, reverse=True), 1)}
        #: When merging makes a token; 0: it is there from the start. Equal scores merge from left to right.
        self.when = [0] * (len(self.texts) + 1)
        for p, i in normal.items():
            if len(p) > 1:
                self.when[i] = levels[model.pieces[i][1]]
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for text, number in self.numbers.items():
            if len(text) > 1:
                halves = self._halves(text)
                if halves is None:
                    continue  # merging never makes this piece
                self.halves[number] = halves
            self.automaton.add_word(text, (len(text), number))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}

        # Ids of each token, and bytes of each id.
        self.ids_of = [(i,) for i in range(len(model.pieces))] + [self._fallback(c) for c in self.texts[len(model.pieces) :]]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if i == unknown else p.replace(SPACE, " ").encode() for i, (p, _, kind) in enumerate(model.pieces)]
        self.names = [str(i) for i in range(len(model.pieces))]

        apart = "".join(c for c in "\n\t\r" if c not in chars and c not in normal)
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            self.units = re.compile(r"(?s).+")
        elif apart:
            self.units = re.compile(f"{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+|[{apart}]")
        else:
            self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.cache: dict[str, tuple[int, ...]] = {}

    def _halves(self, text: str) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes ``text``; None if merging doesn't end in it."""
        parts = list(text)
        while len(parts) > 2:
            joined = [self.when[n] if (n := self.numbers.get(a + b)) is not None else 0 for a, b in zip(parts, parts[1:], strict=False)]
            best = min((w for w in joined if w), default=0)
            if not best:
                return None
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.numbers[parts[0]], self.numbers[parts[1]]

    def _fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode())

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens leaves just these two.

        Undoes the merges next to the border from the latest on, and looks for a
        merge across the border that would have come before what was undone.
        """
        when, texts, numbers, halves = self.when, self.texts, self.numbers, self.halves
        bound = len(texts) + 1
        while True:
            across = numbers.get(texts[left] + texts[right])
            if across is not None and when[across] < bound:
                return False
            a, b = when[left], when[right]
            if not a and not b:
                return True
            if a > b:  # of equal ones the right one came later
                bound, left = a, halves[left][1]
            else:  # a merge across the border of the same score lies further left
                bound, right = b + 1, halves[right][0]

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit by its prefix table."""
        n, foreign, compatible = len(unit), self.foreign, self.compatible
        last: list[tuple[int, int] | None] = [None] * (n + 1)  # length and number of the last token of each prefix
        if len(compatible) > CACHE_PAIRS:
            compatible.clear()
        for at, found in self.automaton.iter(unit):
            if last[at + 1] is not None:
                continue
            length, number = found
            start = at + 1 - length
            if start:
                before = last[start]
                if before is None:
                    before = last[start] = (1, foreign)
                if before[1] != foreign:
                    pair = (before[1], number)
                    ok = compatible.get(pair)
                    if ok is None:
                        ok = compatible[pair] = self.fits(*pair)
                    if not ok:
                        continue
            last[at + 1] = found
        out, at = [], n
        while at:
            length, number = last[at] or (1, foreign)
            at -= length
            out.append(self._fallback(unit[at]) if number == foreign else self.ids_of[number])
        return tuple(chain.from_iterable(reversed(out)))

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without an end id."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.dummy_prefix:
            text = SPACE + text
        units = self.units.findall(text)
        cache = self.cache
        if len(cache) > CACHE_UNITS:
            cache.clear()
        long = []
        for unit in set(units):
            if unit not in cache:
                cache[unit] = self._unit(unit)
                if len(unit) > CACHE_CHARS:
                    long.append(unit)
        out = list(chain.from_iterable(map(cache.__getitem__, units)))
        for unit in long:
            del cache[unit]
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_CODECS: dict[int, PrefixTableCodec] = {}


def codec_of(model: bytes) -> PrefixTableCodec:
    """One codec for each model and worker process."""
    key = zlib.crc32(model)
    if key not in _CODECS:
        _CODECS[key] = PrefixTableCodec(model)
    return _CODECS[key]


# --- operators --------------------------------------------------------------


def encode(docs: DataFrame, model: bytes, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column ``ids``: array<int> of the piece ids and the end id."""

    @F.pandas_udf("array<int>")
    def run(texts):
        codec = codec_of(model)
        return texts.map(lambda t: [*codec.encode(t or ""), codec.end_id])

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, model: bytes, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the column ``text`` of what ``ids`` decode to."""

    @F.pandas_udf("string")
    def run(rows):
        codec = codec_of(model)
        return rows.map(lambda r: codec.decode(r if r is not None else []))

    return docs.withColumn(text, run(F.col(ids)))


def _digests(codec: PrefixTableCodec, texts: pa.Array) -> Iterator[tuple[list[int], str, str]]:
    """Ids, and the digests of the ids and of what they decode to, of each text; ids of a document at a time."""
    names = codec.names.__getitem__
    for value in texts:
        ids = codec.encode(value.as_py() or "")
        ids.append(codec.end_id)
        yield ids, hashlib.sha256(" ".join(map(names, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def digest(docs: DataFrame, model: bytes, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text; return key, n_tokens, ids_sha256, decoded_sha256.

    Ids are never all in memory at once: each document is hashed as it comes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            found = [(len(ids), a, b) for ids, a, b in _digests(codec, batch.column(1))]
            counts, id_hashes, text_hashes = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = found.schema["key"].dataType.simpleString()
    return found.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def encoded(docs: DataFrame, model: bytes, *, text: str = "text") -> DataFrame:
    """``docs`` with ids (array<int>, the end id included), n_tokens, ids_sha256 and decoded_sha256, which replace columns of these names."""
    from pyspark.sql.types import StructType

    new = StructType.fromDDL("ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    columns = [c for c in docs.columns if c not in new.names]
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            flat, counts, id_hashes, text_hashes = array("i"), [], [], []
            for ids, a, b in _digests(codec, batch.column(at)):
                flat.extend(ids)
                counts.append(len(ids))
                id_hashes.append(a)
                text_hashes.append(b)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(flat, np.int32)) if flat else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())], [*columns, *new.names])

    return docs.select(*columns).mapInArrow(run, StructType([*[docs.schema[c] for c in columns], *new.fields]))
