"""Vector and scoring scalars as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of each type of memory.
TYPE_WEIGHTS = {"fact": 1.20, "decision": 1.10, "lesson": 1.05, "preference": 1.15, "episodic": 0.95, "raw": 1.00}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def normalized(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def truncated(a: Column, k: int) -> Column:
    """First k dimensions, normalised; empty if k is 0 or too large."""
    return F.when((F.lit(k) > 0) & (F.lit(k) <= F.size(a)), normalized(F.slice(a, 1, k) if k > 0 else a)).otherwise(F.array().cast("array<double>"))


def sign_words(a: Column, dim: int) -> list[Column]:
    """Signs of a vector (1 for above zero) packed into 32-bit words held as bigint."""
    out = []
    for start in range(0, dim, 32):
        word = F.lit(0).cast("bigint")
        for i in range(start, min(start + 32, dim)):
            word = word + F.when(F.element_at(a, i + 1) > 0, F.lit(1 << (i - start)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        out.append(word)
    return out


def hamming(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def int8_scale(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / 127


def int8(a: Column) -> Column:
    scale = int8_scale(a)
    return F.when(scale > 0, F.transform(a, lambda x: F.least(F.greatest(F.round(x.cast("double") / scale), F.lit(-127.0)), F.lit(127.0)).cast("int"))).otherwise(F.transform(a, lambda x: F.lit(0)))


def distance_score(d: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d)


def reciprocal_rank(rank: Column, k: float = 60.0) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def age_days(ts: Column, now: int) -> Column:
    return F.greatest((F.lit(now) - ts) / 86400.0, F.lit(0.0))


def recall_heat(score: Column, ts: Column, now: int) -> Column:
    return F.greatest(F.pow(F.lit(0.97), age_days(ts, now)), F.lit(0.3)) * score


def usage_heat(score: Column, accesses: Column, ts: Column, now: int) -> Column:
    return score * (1 + F.log1p(accesses.cast("double"))) * F.exp(-0.05 * age_days(ts, now))


def decay(strength: Column, touched: Column, interactions: Column, now: int, half_life: int) -> Column:
    """Strength halved over each half-life, with a boost for the last hour and for use."""
    elapsed = F.greatest(F.lit(now) - touched, F.lit(0))
    return strength * F.pow(F.lit(0.5), elapsed / F.lit(float(half_life))) * F.when(elapsed < 3600, 1.2).otherwise(1.0) * (1 + F.least(0.05 * interactions, F.lit(0.5)))


def touched(strength: Column) -> Column:
    return F.least(strength + 0.1, F.lit(1.0))


def rerank_blend(rerank: Column, original: Column) -> Column:
    return 0.7 * rerank + 0.3 * original


def grade_blend(fused: Column, grade: Column) -> Column:
    return 0.6 * fused + 0.4 * grade


def bucket(score: Column) -> Column:
    return F.least(F.greatest(F.floor(score * 10), F.lit(0)), F.lit(9))


def calibrated(score: Column, correction: Column) -> Column:
    return F.least(F.greatest(score * F.coalesce(correction, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))


def kind_bonus(wins: Column, losses: Column) -> Column:
    return F.coalesce(wins / F.nullif(wins + losses, F.lit(0)), F.lit(0.0)) * 0.03


def type_weight(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in TYPE_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def half(a: Column) -> Column:
    """Each number as the nearest 16-bit float (ties to even), kept as a double; beyond the largest it is infinite."""

    def one(x: Column) -> Column:
        x = x.cast("double")
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
        near = F.bround(x / step, 0) * step
        return F.when(x == 0, F.lit(0.0)).when(F.abs(near) > 65504, F.when(x > 0, float("inf")).otherwise(float("-inf"))).otherwise(near)

    return F.transform(a, one)


def pack_floats(a: Column) -> Column:
    """A vector as little-endian 32-bit floats."""
    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(rows.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).astype("<f4")
        offsets = np.append(0, 4 * np.cumsum(lengths)).astype(np.int32)
        out = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        return out if not rows.null_count else pc.if_else(rows.is_valid(), out, pa.scalar(None, pa.binary()))

    return run(a)


def unpack_floats(a: Column) -> Column:
    """The vector of little-endian 32-bit floats; null if the bytes aren't whole floats."""
    @F.arrow_udf("array<float>")
    def run(rows: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.binary_length(rows), 1).to_numpy(zero_copy_only=False)
        whole = lengths % 4 == 0
        data = b"".join(memoryview(v.as_buffer()) for v, good in zip(rows, whole, strict=True) if good)
        offsets = np.append(0, np.cumsum(np.where(whole, lengths // 4, 0)))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(data, "<f4")), mask=pa.array(~whole))

    return run(a)
