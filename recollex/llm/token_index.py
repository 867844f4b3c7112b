"""Token ids in binary shards, with a minimal perfect hash index from document keys.

A dataset is a folder of shards in ascending key order::

    shard-000000.ids   raw little-endian ids of all its documents, one after the other
    shard-000000.mph   header, record offsets, minimal perfect hash, fingerprints, slots
    manifest/          Parquet: shard, n_docs, n_tokens, base (ids in all earlier shards)

A lookup hashes the key to a slot, compares the stored 32-bit fingerprint, and
seeks to the record; that costs the same for any shard size. A key that was never
stored passes the fingerprint with a chance of 2**-32.

Defined results. Null text counts as empty. Null keys come first in the order and
are found under the null key. Repeated keys keep all their records, next to each
other, ordered by the checksum of the payload and then the payload; a lookup
returns all of them. A key that holds the rows of several shards is dealt to these
by checksum, so that no task gets it whole.
An empty table makes a dataset without shards. Texts of any length are encoded
whole, piece by piece. Other columns are ignored, whatever their names. The string
of an added token in a text becomes that token, as the tokenizers library has it
by default. Ids are stored as 16-bit numbers if the vocabulary allows it.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.storage import materialize

MAGIC = b"RCXIDS01"
DOCS_PER_SHARD = 4096
#: Beyond this many shards these grow; they are streamed, so their tasks hold keys and offsets alone.
MAX_SHARDS = 65_536
CACHE_UNITS = 400_000
CACHE_CHARS = 48
LATIN = "\u024f"
# Fixed value: the published pre-token pattern of byte-level BPE.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- encoding ---------------------------------------------------------------

_UNEVEN_SPACE = re.compile(r" (?=\s)|(?<=\s) ")
#: The same for Arrow, whose white space is that of ASCII unless told.
UNEVEN = r"(?: [\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}] )"
SLICE = 8 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Recent:
    """A cache of at most twice ``most`` entries that keeps what was used of late."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key: str, make):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = make(key)
                if len(key) > CACHE_CHARS:
                    return found
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found


class ByteBpeEncoder:
    """Byte-level BPE of the tokenizers library, with a cache of space-separated units.

    Between two non-space characters a single space always starts a new
    pre-token, so a text can be cut there and its parts encoded apart: each part
    is then encoded once per worker, and a long text never becomes one large
    Encoding. Texts that hold the string of an added token are cut there first.
    """

    def __init__(self, model: bytes, cache_units: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache, self.parts = Recent(cache_units), Recent(cache_units // 2)
        self.bpe, self.split = self.tokenizer.model, None
        told = json.loads(model)
        added = told.get("added_tokens") or []
        self.added = {x["content"]: x["id"] for x in added}
        # The leftmost and of these the longest counts, as in the library; tokens with conditions on what is around them are left to it.
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.cuttable = not any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") or x.get("normalized") for x in added)
        pre = told.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer"):
            self.split = regex.compile(BYTE_LEVEL).findall
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            self.space = "\u0120"
            self.spelling = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in printable)}

    def _whole(self, unit: str) -> bytes:
        return self._raw(self.tokenizer.encode_batch_fast([unit], add_special_tokens=False)[0].ids)

    def _raw(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a pre-token."""
        if part.isascii() and (part[1:].isalpha() if part[0] == " " else part.isalpha()):
            spelled = part.replace(" ", self.space)
        else:
            spelled = part.encode().decode("latin-1").translate(self.spelling)
        return self._raw([x.id for x in self.bpe.tokenize(spelled)])

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit, with those of its pre-tokens from the cache.

        Which characters are letters differs between versions of Unicode, so
        pre-tokens are told here for Latin text alone.
        """
        if self.split is None or not (unit.isascii() or max(unit) <= LATIN):
            return self._whole(unit)
        if unit[0] == " " and unit[1:].isalpha():
            return self.parts.get(unit, self._part)
        return b"".join([self.parts.get(part, self._part) for part in self.split(unit)])

    def encode(self, text: str) -> bytes:
        """The ids of a text as raw bytes of ``dtype``."""
        if self.cut is None or not self.cut.search(text):
            return self._encode_plain(text)
        if not self.cuttable:
            return self._whole(text)
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += [self._encode_plain(text[at : found.start()]), self._raw([self.added[found.group()]])]
            at = found.end()
        return b"".join([*out, self._encode_plain(text[at:])])

    def _encode_plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text:
            return b""
        head, *units = _CUT.split(text) if _UNEVEN_SPACE.search(text) else text.split(" ")
        return (self._unit(head) if head else b"") + b"".join([self.cache.get(u, self._spaced) for u in units])

    def _spaced(self, unit: str) -> bytes:
        return self._unit(" " + unit)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of many texts (none null), SLICE bytes at a time.

        The units of a slice are told apart once, in compiled code; each distinct
        one is encoded, and the ids are then gathered by position.
        """
        out: list[bytes] = []
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + SLICE, side="right")))
            out += self._encode_slice(texts.slice(start, end - start))
            start = end
        return out

    def _encode_slice(self, texts: pa.Array) -> list[bytes]:
        apart = pc.match_substring_regex(texts, UNEVEN)
        for name in self.added:
            apart = pc.or_(apart, pc.match_substring(texts, name))
        uneven = apart.to_numpy(zero_copy_only=False)
        out: list[bytes | None] = [None] * len(texts)
        for i in np.flatnonzero(uneven).tolist():
            out[i] = self.encode(texts[i].as_py())
        even = np.flatnonzero(~uneven)
        if not len(even):
            return out
        lists = pc.split_pattern(texts.take(pa.array(even)).cast(pa.large_string()), " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        units = lists.flatten().dictionary_encode()
        at = units.indices.to_numpy().astype(np.int64)
        names = units.dictionary.to_pylist()
        heads = offsets[:-1]
        found = [self.cache.get(name, self._spaced) for name in names]
        for i in at[heads].tolist():
            found.append(self._unit(names[i]) if names[i] else b"")
        at[heads] = np.arange(len(names), len(found))
        ids = np.frombuffer(b"".join(found), self.dtype)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        firsts = np.cumsum(lengths) - lengths
        n = lengths[at]
        ends = np.cumsum(n)
        placed = ids[np.repeat(firsts[at] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        cuts = np.concatenate([[0], ends])[offsets] * self.dtype.itemsize
        for i, a, b in zip(even.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[i] = placed[a:b]
        return out


_ENCODERS: dict[int, ByteBpeEncoder] = {}


def encoder_of(model: bytes) -> ByteBpeEncoder:
    """One encoder for each model and worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = zlib.crc32(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBpeEncoder(model)
    return _ENCODERS[key]


# --- minimal perfect hash ---------------------------------------------------

GAMMA = 2.0
MAX_LEVELS = 48


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 finaliser of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Cascade of bit arrays: a key owns the first level where no other key hits its bit.

    The slot of a key is the rank of its bit over all levels, so n keys fill
    exactly the slots 0..n-1.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct 64-bit integers."""
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        sizes, words = [], []
        for level in range(MAX_LEVELS):
            if not len(keys):
                break
            m = max(64, -(-int(GAMMA * len(keys)) // 64) * 64)
            at = (_mix(keys, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        if len(keys):
            raise ValueError("keys are not distinct")
        return cls(np.array(sizes, "<i8"), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for keys that hit no bit and so were never stored."""
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            bit = (_mix(keys[left], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            word = self.words[bit >> 6]
            shift = (bit & 63).astype(np.uint64)
            hit = ((word >> shift) & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[bit[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(np.asarray(keys).astype(np.int64).view(np.uint64), 7777) >> np.uint64(32)).astype("<u4")


class ShardIndex:
    """Index of one shard: offsets of records, and slots that name a key's records."""

    def __init__(self, head: dict, offsets: np.ndarray, mph: PerfectHash, prints: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.head, self.offsets, self.mph, self.prints, self.first, self.count = head, offsets, mph, prints, first, count

    @classmethod
    def build(cls, keys: np.ndarray, nulls: int, lengths: np.ndarray, dtype: str) -> ShardIndex:
        """keys: ascending, without the ``nulls`` records that come first."""
        distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
        mph = PerfectHash.build(distinct)
        slots = mph.slots(distinct)
        prints, at, n = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
        prints[slots], at[slots], n[slots] = fingerprints(distinct), first + nulls, count
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        return cls({"dtype": dtype, "nulls": nulls, "docs": len(lengths), "keys": len(distinct)}, offsets, mph, prints, at, n)

    def dump(self) -> bytes:
        parts = [self.offsets, self.mph.sizes, self.mph.words, self.prints, self.first, self.count]
        head = json.dumps(self.head | {"parts": [[x.dtype.str, len(x)] for x in parts]}).encode()
        return MAGIC + struct.pack("<I", len(head)) + head + b"".join(x.tobytes() for x in parts)

    @classmethod
    def load(cls, data: bytes) -> ShardIndex:
        if data[:8] != MAGIC:
            raise ValueError("not a shard index")
        (n,) = struct.unpack_from("<I", data, 8)
        head, at, parts = json.loads(data[12 : 12 + n]), 12 + n, []
        for kind, length in head["parts"]:
            parts.append(np.frombuffer(data, kind, length, at))
            at += np.dtype(kind).itemsize * length
        return cls(head, parts[0], PerfectHash(parts[1], parts[2]), *parts[3:])

    def records(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; 0 records if it is not stored."""
        slots = self.mph.slots(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == fingerprints(np.asarray(keys)[known])
        first, count = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        first[known], count[known] = self.first[slots[known]], self.count[slots[known]]
        return first, count


# --- shards -----------------------------------------------------------------


#: Stands for the null key among the bounds.
LEAST = -(2**63)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _names(folder: str, shard: int) -> tuple[str, str]:
    return f"{folder}/shard-{shard:06d}.ids", f"{folder}/shard-{shard:06d}.mph"


def _bounds(docs: DataFrame, key: str, docs_per_shard: int, max_shards: int) -> list[int]:
    """At most ``max_shards`` - 1 keys that cut the key order into shards of like size; a key may cut several times.

    Reads the key column alone; the result does not grow with the documents.
    """
    n = docs.select(F.count(F.lit(1))).first()[0]
    shards = min(max_shards, -(-n // docs_per_shard))
    if shards < 2:
        return []
    cuts = [i / shards for i in range(1, shards)]
    return sorted(docs.select(F.percentile_approx(F.coalesce(F.col(key), F.lit(LEAST)), cuts, 4 * MAX_SHARDS)).first()[0])


def _spans(bounds: np.ndarray, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each key; null is the smallest key."""
    values = keys.fill_null(LEAST).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(bounds, values, side="left"), np.searchsorted(bounds, values, side="right")
    several = high - low >= 2
    return np.where(several, low + 1, high), np.where(several, high - low, 1)


def write_dataset(docs: DataFrame, path: str, model: bytes, *, key: str = "doc_id", text: str = "text", end_id: int | None = 2, docs_per_shard: int = DOCS_PER_SHARD, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Encode ``docs``, write the dataset to the URI ``path`` and return its manifest.

    Texts are encoded where they are read, so only ids are shuffled. A shard is
    written by one task as a stream, first under a name of its own and then
    renamed, so a repeated task replaces it whole. Memory holds the keys and
    offsets of a shard, never its ids.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = np.array(_bounds(docs, "key", docs_per_shard, max_shards), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        tail = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            keys = batch.column(0)
            ids = [x + tail for x in encoder.encode_all(batch.column(1))]
            ties = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))
            first, several = _spans(bounds, keys)
            shards = (first + (ties * several >> 32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.array(shards), pa.array(ties), pa.array(ids, pa.binary())], ["key", "shard", "tie", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _filesystem(path)
        kind = encoder_of(model).dtype
        mine, out, shard = uuid.uuid4().hex, None, None
        keys: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        nulls = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                shard = batch.column(1)[0].as_py()
                out = system.open_output_stream(f"{folder}/.{mine}.ids", compression=None)
            nulls += batch.column(0).null_count
            keys.append(batch.column(0).drop_null().to_numpy())
            ids = batch.column(2)
            lengths.append(np.array([len(x.as_buffer()) for x in ids], np.int64) // kind.itemsize)
            for x in ids:
                out.write(x.as_buffer())
        if out is None:
            return
        out.close()
        index = ShardIndex.build(np.concatenate(keys), nulls, np.concatenate(lengths), kind.str)
        with system.open_output_stream(f"{folder}/.{mine}.mph", compression=None) as f:
            f.write(index.dump())
        for part, name in zip((f"{folder}/.{mine}.ids", f"{folder}/.{mine}.mph"), _names(folder, shard), strict=True):
            system.move(part, name)
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([index.head["docs"]], pa.int64()), "n_tokens": pa.array([int(index.offsets[-1])], pa.int64())}
        )

    system, folder = _filesystem(path)
    system.create_dir(folder, recursive=True)
    shards = len(bounds) + 1
    manifest = (
        docs.mapInArrow(encode, "key long, shard int, tie long, ids binary")
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "tie", "ids")
        .select("key", "shard", "ids")
        .mapInArrow(write, "shard int, n_docs long, n_tokens long")
    )
    manifest = materialize(manifest, "manifest", f"{path}/shards")
    # One row for each of at most max_shards shards.
    based = manifest.selectExpr("*", "coalesce(sum(n_tokens) over (order by shard rows between unbounded preceding and 1 preceding), 0) as base")
    based = materialize(based.coalesce(1), "manifest", f"{path}/manifest")
    with system.open_output_stream(f"{folder}/bounds.json", compression=None) as f:
        f.write(json.dumps([int(x) for x in bounds]).encode())
    return based


def lookup(spark: SparkSession, path: str, keys: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Records of ``keys`` (distinct, null allowed) by their index.

    Returns key, start (ids of all records before it), n_tokens, ids (binary, as
    stored), ids_crc32 (unsigned, over the ids as 32-bit integers). Keys that are
    not stored return nothing.
    """
    system, folder = _filesystem(path)
    with system.open_input_stream(f"{folder}/bounds.json", compression=None) as f:
        bounds = np.array(json.loads(f.read()), np.int64)
    manifest = spark.read.parquet(f"{path}/manifest")
    bases = {r["shard"]: r["base"] for r in manifest.select("shard", "base").collect()}  # at most max_shards

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0)
            first, several = _spans(bounds, asked)
            ends = np.cumsum(several)
            shards = np.repeat(first - (ends - several), several) + np.arange(several.sum())
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(np.repeat(np.arange(len(asked)), several))), pa.array(shards.astype(np.int32))], ["key", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _filesystem(path)
        index = data = shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if index is None:
                shard = batch.column(1)[0].as_py()
                if shard not in bases:
                    return
                ids_name, mph_name = _names(folder, shard)
                with system.open_input_stream(mph_name, compression=None) as f:
                    index = ShardIndex.load(f.read())
                data = system.open_input_file(ids_name)
            kind = np.dtype(index.head["dtype"])
            asked = batch.column(0)
            values = asked.fill_null(0).to_numpy(zero_copy_only=False)
            first, count = index.records(values)
            blank = asked.is_null().to_numpy(zero_copy_only=False)
            first[blank], count[blank] = 0, index.head["nulls"]
            rows: list[tuple] = []
            for value, null, at, n in zip(values.tolist(), blank.tolist(), first.tolist(), count.tolist(), strict=True):
                for record in range(at, at + n):
                    a, b = int(index.offsets[record]), int(index.offsets[record + 1])
                    raw = data.read_at((b - a) * kind.itemsize, a * kind.itemsize)
                    crc = zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes())
                    rows.append((None if null else value, bases[shard] + a, b - a, raw, crc))
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], fields)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], fields)

    fields = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])
    return (
        keys.select(F.col(key).cast("long").alias("key")).distinct().mapInArrow(route, "key long, shard int")
        .repartitionById(len(bounds) + 1, F.col("shard"))
        .mapInArrow(read, "key long, start long, n_tokens long, ids binary, ids_crc32 long")
        .withColumnRenamed("key", key)
    )
