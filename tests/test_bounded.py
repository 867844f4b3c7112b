"""Steps that once held a whole pool, or a row for each pair or word: against plain results, and by their plans."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from recollex.operators import packing, vectors
from recollex.operators.packing import PackOptions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_pool_larger_than_a_batch_is_packed_in_order(spark):
    rows = [(i % 2, i, ("fact", "code", "decision")[i % 3], (i * 37 % 101) / 101, f"word{i % 40} says {'x' * (i % 9)} number{i}") for i in range(400)]
    pool = spark.createDataFrame(rows, "qid long, id long, kind string, score double, text string")
    options, name = PackOptions(budget=300, reserve=0, previous=(7,)), "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    got = {}
    for most in ("1000", "7"):
        spark.conf.set(name, most)
        got[most] = sorted((r["qid"], r["position"], r["id"], r["tier"], r["tokens"]) for r in packing.pack(pool, options).collect())
    spark.conf.set(name, kept)
    want = []
    for qid in (0, 1):
        used, prints, taken = 0, [], []
        for r in packing.with_tiers(pool.filter(F.col("qid") == qid)).orderBy(F.desc("trusted"), "id").collect():
            if used >= 300 or any(((r["simhash"] ^ p) & packing.MASK).bit_count() <= 3 for p in prints):
                continue
            tiers = packing.TIERS[: packing.TIERS.index(packing.FLOORS.get(r["kind"], "one_line")) + 1]
            if fit := [t for t in tiers if r[f"n_{t}"] and used + r[f"n_{t}"] <= 300]:
                taken.append((r["id"], fit[0], r[f"n_{fit[0]}"]))
                prints.append(r["simhash"])
                used += taken[-1][2]
        first = [t for t in taken if t[0] == 7]
        rest = [t for t in taken if t[0] != 7]
        rest = [rest[0], *rest[2:], rest[1]] if len(rest) > 2 else rest
        want += [(qid, n, *t) for n, t in enumerate(first + rest, 1)]
    assert got["1000"] == got["7"] == want
    assert "FlatMapGroups" not in plan(packing.pack(pool, options))


def test_consolidate_compares_tiles(spark):
    x = np.random.default_rng(4).standard_normal((120, 8))
    x[5], x[6] = x[4] * 2, 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [None] * 8), (202, [1.0])]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    buckets = {r["id"]: r["bucket"] for r in vectors.plane_buckets(frame.filter("id < 200"), 8, planes=2).collect()}
    length = np.linalg.norm(x, axis=1)
    want = {}
    for a in range(120):
        for b in range(a + 1, 120):
            c = x[a] @ x[b] / (length[a] * length[b]) if length[a] * length[b] else 0.0
            if buckets[a] == buckets[b] and c > 0.3:
                want[a, b] = c
    found = vectors.consolidate(frame, 8, threshold=0.3, planes=2, tile=16)
    got = {(r["keep"], r["drop"]): r["cosine"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_expansion_sums_within_a_row(spark):
    texts = [(1, "One two two three"), (2, None), (3, "one ONE"), (3, "two one")]
    docs = spark.createDataFrame(texts, "id long, text string")
    want = {}
    for i, words in ((1, {"one", "two", "three"}), (3, {"one", "two"})):
        for w in words:
            for j in range(4):
                h = hashlib.md5(f"{w}:{j}".encode()).hexdigest()
                key = i, int(h[:8], 16) % 30522
                want[key] = want.get(key, 0) + math.log1p(int(h[8:16], 16) / 2**32)
    got = {(r["id"], r["term"]): r["weight"] for r in vectors.sparse_expand(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "Exchange" not in plan(vectors.sparse_expand(docs.filter("id < 3")))
