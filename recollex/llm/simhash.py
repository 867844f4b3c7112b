"""SimHash near-duplicates, linked by bit-sliced comparison.

A text's words are hashed in runs of four; bit i of its fingerprint is set if bit
i is set in more than half of the hashes. Fingerprints within a radius of
differing bits are linked, and linked documents form components.

Candidates come from block keys: 64 bits are cut into ``BLOCKS`` blocks, and two
fingerprints within the radius agree in all of them but ``radius``, so
each choice of that many blocks is a key. Nothing within the radius is missed.
Only distinct fingerprints take part. Fingerprints that share a key are compared
in tiles: a tile holds its fingerprints as 64 bit planes, one machine word for
64 of them; a row of the tile takes in one plane after the other with carry-save
counters of three bits, a distance over the radius sticks, and rows whose
distances are all beyond it are abandoned. A key with more fingerprints than a
tile holds is dealt into chunks and each pair of chunks is a tile, so that no
task gets a hot key whole. A tile hands on a spanning forest of its links, never
all its pairs.

A fingerprint or a component with much of the rows is never shuffled by its key:
what is known of it is broadcast (``skew.join_facts``).

Defined results. Null text counts as empty. Texts without words have fingerprint
zero and are linked like any other. Texts of any length are hashed whole, a text
at a time. Documents with the same text, and repeated rows, share a component.
Rows with a null key stay, but never name a component: a component whose keys are
all null is null. Ties between keys can't matter, since the smallest is taken. An
empty table gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.llm.components import components
from recollex.llm.skew import join_facts
from recollex.storage import materialize, small

WORDS = 4
RADIUS = 4
SEED = 42
#: Most distinct fingerprints for each number of blocks that 64 bits are cut into. Within four differing bits two
#: of six blocks agree (15 keys of about 21 bits), three of seven (35 of 27) and four of eight (70 of 32).
BLOCKS = ((1 << 28, 6), (1 << 34, 7), (1 << 63, 8))
#: Fingerprints compared at once; a key with more is dealt into chunks of half of it.
TILE = 512


# --- fingerprints -----------------------------------------------------------


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of a text as an unsigned 64-bit number."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()  # bytes.lower() and split() know ASCII alone
    if not parts:
        return 0
    if len(parts) <= words:
        return xxh64_intdigest(b" ".join(parts), SEED)
    joined = memoryview(b" ".join(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = np.concatenate([[0], ends[: len(parts) - words] + 1])
    n = len(parts) - words + 1
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of ``hashes``."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, fp): fp as a signed 64-bit number, mark a hash that tells the texts of a key apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "") for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["key", "mark", "fp"])

    docs = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return docs.mapInArrow(run, "key long, mark long, fp long")


# --- bit-sliced comparison --------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 planes of packed bits, 64 fingerprints to a word."""
    n = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    words = np.zeros((64, -(-n // 64) * 8), np.uint8)
    words[:, : packed.shape[1]] = packed
    return words.view("<u8")


def close_pairs(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of fingerprints within ``radius`` (at most 6) differing bits.

    Distances of a row to all others are kept bit-sliced: three words of counter
    bits and one of sticky overflow for 64 distances.
    """
    n = len(fps)
    planes = bit_planes(fps)
    width = planes.shape[1]
    rows = np.arange(n)
    # Lanes at or before a row count as beyond the radius from the start.
    lanes = np.arange(width * 64)
    beyond = np.packbits((lanes[None, :] <= rows[:, None]) | (lanes[None, :] >= n), axis=1, bitorder="little").view("<u8")
    start = np.uint64(7 - radius)
    full = ~np.uint64(0)
    ones, twos, fours = (np.full((n, width), full if start >> np.uint64(k) & np.uint64(1) else 0, np.uint64) for k in range(3))
    for bit in range(64):
        own = (fps[rows] >> np.uint64(bit)) & np.uint64(1)
        differ = planes[bit][None, :] ^ (np.uint64(0) - own)[:, None]
        carry = ones & differ
        ones ^= differ
        differ = twos & carry
        twos ^= carry
        carry = fours & differ
        fours ^= differ
        beyond |= carry  # the counter began at 7 - radius, so it overflows beyond the radius
        if bit % 8 == 7:
            alive = ~(beyond == full).all(axis=1)
            if not alive.all():
                rows, ones, twos, fours, beyond = rows[alive], ones[alive], twos[alive], fours[alive], beyond[alive]
                if not len(rows):
                    return rows, rows
    near = np.unpackbits((~beyond).view(np.uint8), axis=1, bitorder="little")
    at, j = np.nonzero(near)
    return rows[at], j


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the pairs join, at most one for each node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _tile_edges(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    fps = np.unique(fps)
    i, j = close_pairs(fps.view(np.uint64), radius)
    kept = np.array(_forest(i, j), np.int64).reshape(-1, 2)
    return fps[kept[:, 0]], fps[kept[:, 1]]


# --- links ------------------------------------------------------------------


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Array of the block keys of a fingerprint, hashed with their choice of blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for number, choice in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum((1 << edges[b + 1]) - (1 << edges[b]) for b in choice)
        mask -= (1 << 64) * (mask >> 63)
        keys.append(F.xxhash64(fp.bitwiseAND(F.lit(mask)), F.lit(number)))
    return F.array(*keys)


def links(fps: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS[0][1], tile: int = TILE) -> DataFrame:
    """(src, dst): a forest that joins all distinct fingerprints ``fp`` within the radius, step by step."""
    chunk = tile // 2
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("key"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    # Keys of more than a tile are few; broadcast, they leave a hot key's rows where they are until these are dealt.
    dealt = keyed.join(small(materialize(hot, "hot-keys")), "key", "left").withColumn("own", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("fp", F.lit(1)), "chunks").cast("int")))
    # Chunk c meets every chunk: the pair (c, d) is the tile of the two.
    tiles = dealt.select(
        "fp", "key",
        F.explode(F.when(F.col("own").isNull(), F.array(F.lit(-1))).otherwise(F.expr("transform(sequence(0, chunks - 1), d -> least(own, d) * chunks + greatest(own, d))"))).alias("pair"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_group = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush(fp: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Tiles of whole groups; cuts: where groups end."""
            at = 0
            while at < len(fp):
                fit = np.searchsorted(cuts, at + tile, side="right") - 1
                end = cuts[fit] if fit >= 0 and cuts[fit] > at else cuts[np.searchsorted(cuts, at, side="right")]
                a, b = _tile_edges(fp[at:end], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])
                at = end

        for batch in batches:
            fp = np.concatenate([held_fp, batch.column(0).to_numpy()])
            group = np.concatenate([held_group, batch.column(1).to_numpy()])
            cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
            if not len(cuts):
                held_fp, held_group = fp, group
                continue
            yield from flush(fp[: cuts[-1]], cuts)
            held_fp, held_group = fp[cuts[-1] :], group[cuts[-1] :]
        if len(held_fp):
            yield from flush(held_fp, np.array([len(held_fp)]))

    grouped = tiles.select("fp", F.xxhash64("key", "pair").alias("group"))
    return grouped.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "src long, dst long").distinct()


def _classes(prints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Distinct fingerprints (fp, first, n) with their smallest row; (fp, component) of the linked ones; numbers of fingerprints and rows."""
    least = F.min(F.struct(F.col("key").isNull().alias("blank"), "key", "mark"))  # null keys come last
    firsts = materialize(prints.groupBy("fp").agg(least.alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    distinct, total = firsts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = next(b for most, b in BLOCKS if distinct <= most)
    return firsts, components(links(firsts.select("fp"), radius=radius, blocks=blocks)).withColumnRenamed("node", "fp"), distinct, total


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Return key, fingerprint (16 hex digits), component_id (smallest key of the component)."""
    prints = materialize(with_fingerprint(docs, key=key, text=text), "fingerprints")
    firsts, linked, distinct, total = _classes(prints, radius)
    linked = linked.join(firsts.select("fp", "first"), "fp")
    names = linked.groupBy("component").agg(F.min("first").alias("named"), F.count(F.lit(1)).alias("size"))
    named = join_facts(linked.select("fp", "component"), names, ["component"], total=distinct, n="size").select("fp", "named")
    classes = firsts.join(named, "fp", "left").select("fp", "n", F.coalesce("named", "first")["key"].alias("component_id"))
    return join_facts(prints.drop("mark"), materialize(classes, "classes"), ["fp"], total=total, n="n").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Most rows to drop that are broadcast: 16 bytes each.
BROADCAST_DROPPED = 500_000


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component: that with the smallest key, null keys last, then the smallest text hash.

    Rows are told apart by key and text, so rows that clash on a key but aren't
    linked both stay. Of rows equal in both the smallest stays.
    """
    prints = materialize(with_fingerprint(docs, key=key, text=text), "fingerprints")
    firsts, linked, _, _ = _classes(prints, radius)
    rest = firsts.join(linked, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("first").alias("first"))
    row = F.struct(F.col("key"), F.col("mark"))  # structs are equal where both have nulls
    rows = prints.groupBy("key", "mark").agg(F.count(F.lit(1)).alias("n")).select(row.alias("row"), "n")
    kept = rest.select(F.struct("first.key", "first.mark").alias("row"))
    told = materialize(rows.join(kept.withColumn("kept", F.lit(True)), "row", "left").filter("kept is null or n > 1"), "dropped-or-repeated")
    repeated = told.filter("kept").select("row")
    own = F.struct(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("mark"))
    once = docs.join(small(told.select("row"), BROADCAST_DROPPED), own == F.col("row"), "left_anti")
    if repeated.isEmpty():
        return once
    again = docs.withColumn("__row", own).join(repeated, F.col("__row") == F.col("row"), "left_semi")
    return once.unionByName(again.groupBy("__row").agg(F.min(F.struct(*docs.columns)).alias("__first")).select("__first.*"))
