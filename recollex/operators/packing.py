"""Context packing: near-duplicates, compression tiers, budgets, rendering.

A query's pool is packed in one task, since each choice depends on those before
it. The task gets sizes and fingerprints alone, in order and in batches; texts are
fetched for what was taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.functions import text as tx
from recollex.session import small_batches

FNV_OFFSET, FNV_PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, 0xFFFFFFFFFFFFFFFF
TIERS = ("full", "signatures", "facts", "one_line")
#: Tier below which a kind isn't compressed.
FLOORS = {"decision": "facts", "preference": "facts", "code": "signatures"}
TRUST = {"decision": 0.10, "preference": 0.08, "fact": 0.05, "lesson": 0.05}


def fnv1a(data: bytes) -> int:
    """FNV-1a of 64 bits; a worker keeps the hashes of the words of usual length that it met last."""
    return _kept_fnv1a(data) if len(data) <= 32 else _fnv1a(data)


def _fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & MASK
    return h


_kept_fnv1a = lru_cache(maxsize=1 << 16)(_fnv1a)


def simhash(text: str) -> int:
    """64-bit SimHash of the lower-cased words; 0 for a text without words."""
    words = Counter(text.lower().split())
    if not words:
        return 0
    hashes = np.array([fnv1a(w.encode()) for w in words], np.uint64)
    times = np.array(list(words.values()), np.int64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * (times @ bits) > times.sum(), bitorder="little").view(np.uint64)[0])


def with_simhash(rows: DataFrame, *, text: str = "text") -> DataFrame:
    small_batches(rows.sparkSession)

    @F.pandas_udf("long")
    def run(texts):
        return texts.map(lambda t: int(np.uint64(simhash(t or "")).view(np.int64)))

    return rows.withColumn("simhash", run(F.col(text)))


@dataclass(frozen=True)
class PackOptions:
    budget: int = 2000
    reserve: int = 200
    radius: int = 3
    floor: float = 0.0
    at_least_one: bool = True
    previous: tuple[int, ...] = field(default=())


def with_tiers(candidates: DataFrame) -> DataFrame:
    """The tokens of each tier, the fingerprint and a key of the text: what can be told by Columns is told before rows are packed."""
    out = candidates.withColumn("trusted", F.col("score") + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv]), F.col("kind")), F.lit(0.0)))
    for tier in TIERS:
        out = out.withColumn(f"n_{tier}", tx.estimate_tokens(tx.compress(F.col("text"), tier)))
    return with_simhash(out).withColumn("key", F.xxhash64("text")).select("qid", "id", "key", "kind", "score", "trusted", "simhash", *[f"n_{tier}" for tier in TIERS])


def pack(candidates: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """(qid, position, id, tier, tokens, text) of the candidates (qid, id, kind, score, text) that fit the budget.

    By trusted score; near-duplicates of a taken candidate are left out; each is
    taken in its richest tier that fits, down to the floor of its kind.
    """
    room = options.budget - min(options.reserve, options.budget // 4)

    # Sorted rows stream through a task in batches, so that a pool of any size takes no more memory than one.
    live = with_tiers(candidates).filter((F.col("score") >= options.floor) & ~F.isnan("score"))
    ordered = live.repartition("qid").sortWithinPartitions("qid", F.desc("trusted"), F.asc_nulls_last("id"))
    packed = ordered.mapInArrow(_in_order(options, room), "qid long, position long, id long, tier string, tokens long, key long, cut boolean")
    texts = candidates.select(F.col("qid").alias("_qid"), F.col("id").alias("_id"), "text").withColumn("_key", F.xxhash64("text"))
    same = F.col("qid").eqNullSafe(F.col("_qid")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    text = F.lit(None).cast("string")
    for tier in TIERS:
        text = F.when(F.col("tier") == tier, tx.compress(F.col("text"), tier)).otherwise(text)
    # Rows that repeat a candidate with its text are met more than once.
    found = packed.join(texts, same).dropDuplicates(["qid", "position"])
    return found.select("qid", "position", "id", "tier", "tokens", F.when(F.col("cut"), F.substring(text, 1, 3 * room)).otherwise(text).alias("text"))


def _in_order(options: PackOptions, room: int):
    """Packs pools whose rows come one pool after the other, best first."""

    def placed(qid, best: dict, taken: list[tuple]) -> pa.RecordBatch:
        if not taken and options.at_least_one:
            taken = [(best["id"], "one_line", min(best["n_one_line"] or 0, room), best["key"], True)]
        order = [i for i in options.previous if i in {t[0] for t in taken}]
        rest = [t for t in taken if t[0] not in order]
        if len(rest) > 2:
            rest = [rest[0], *rest[2:], rest[1]]
        rows = [next(t for t in taken if t[0] == i) for i in order] + rest
        columns = [[qid] * len(rows), list(range(1, len(rows) + 1)), *([t[j] for t in rows] for j in range(5))]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["qid", "position", "id", "tier", "tokens", "key", "cut"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, best, used, prints, taken = None, None, 0, [], []
        for batch in batches:
            qids, kinds, hashes = batch.column("qid").to_pylist(), batch.column("kind").to_pylist(), batch.column("simhash").to_numpy()
            sizes = np.stack([batch.column(f"n_{tier}").fill_null(0).to_numpy() for tier in TIERS])
            last = np.array([TIERS.index(FLOORS.get(kind, TIERS[-1])) for kind in kinds], int)
            sizes[np.arange(len(TIERS))[:, None] > last[None]] = 0
            starts = [i for i in range(len(qids)) if i == 0 or qids[i] != qids[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(qids)], strict=True):
                if best is None or qids[start] != qid:
                    if best is not None:
                        yield placed(qid, best, taken)
                    qid, best, used, prints, taken = qids[start], batch.slice(start, 1).to_pylist()[0], 0, [], []
                own = sizes[:, start:end]
                for i in start + np.flatnonzero(((own > 0) & (own <= room - used)).any(axis=0)):
                    if used >= room:
                        break
                    if prints and np.bitwise_count((np.array(prints) ^ hashes[i]).view(np.uint64)).min() <= options.radius:
                        continue
                    fits = np.flatnonzero((sizes[:, i] > 0) & (used + sizes[:, i] <= room))
                    if len(fits):
                        tokens = int(sizes[fits[0], i])
                        taken.append((batch.column("id")[i].as_py(), TIERS[fits[0]], tokens, batch.column("key")[i].as_py(), False))
                        prints.append(hashes[i])
                        used += tokens
        if best is not None:
            yield placed(qid, best, taken)

    return run


def pack_delta(candidates: DataFrame, delivered: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """Pack what was not delivered before; delivered: (id)."""
    return pack(candidates.join(delivered.select("id"), "id", "left_anti"), options)


def render(packed: DataFrame, budget: int) -> DataFrame:
    """(qid, text): a state line and the blocks in order."""
    blocks = F.array_sort(F.collect_list(F.struct("position", "id", "tier", "tokens", "text")))
    block = lambda b: F.concat(F.lit("## "), b["id"].cast("string"), F.lit(" ("), b["tier"], F.lit(")\n"), b["text"])
    out = packed.groupBy("qid").agg(blocks.alias("b"), F.sum("tokens").alias("used"))
    return out.select("qid", F.concat(F.lit("STATE used="), F.col("used").cast("string"), F.lit(f"/{budget}\n"), F.array_join(F.transform("b", block), "\n\n")).alias("text"))


def savings(naive: DataFrame, packed: DataFrame) -> DataFrame:
    """(naive, packed, pct), one row: tokens of whole texts and of what was packed."""
    a = naive.agg(F.coalesce(F.sum(tx.estimate_tokens(F.col("text"))), F.lit(0)).alias("naive"))
    b = packed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("packed"))
    return a.crossJoin(b).withColumn("pct", F.when(F.col("naive") > 0, F.round(100 * (1 - F.col("packed") / F.col("naive")), 4)).otherwise(F.lit(0.0)))  # one row each


def shrunk_budget(budget: int, open_packs: int) -> int:
    """Budget while others are open: three fifths from three on, two fifths from six on, 512 at least."""
    part = 2 / 5 if open_packs >= 6 else 3 / 5 if open_packs >= 3 else 1
    return max(int(budget * part), 512)


def state_of(memories: DataFrame, limit: int) -> DataFrame:
    """Newest facts and decisions that nothing replaced."""
    return memories.filter("superseded_by is null and memory_type in ('fact', 'decision')").orderBy(F.desc("updated_ts"), F.desc("id")).limit(limit)
