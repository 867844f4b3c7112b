"""The projection forest against all pairs."""

import numpy as np

from recollex.operators import forest as fr
from recollex.storage import Scratch

ROW = "id long, embedding array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], ROW)


def near(seed=1, n=1200, dim=16):
    """Vectors of which half lie close to another one."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[n // 2 :] = x[: n - n // 2] + 0.1 * rng.standard_normal((n - n // 2, dim))
    return x


def brute(x, threshold):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.triu(unit @ unit.T, 1)
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(c > threshold), strict=True)}


def test_most_near_pairs_are_found_and_no_others(spark):
    x = near()
    found = fr.consolidate(frame(spark, enumerate(x)), 0.95, leaf=64, trees=8).collect()
    got, want = {(r["keep"], r["drop"]) for r in found}, brute(x, 0.95)
    assert len(got) == len(found) and got <= want and len(got) >= 0.95 * len(want) > 400


def test_leaves_are_bounded_and_hold_each_vector_once_a_tree(spark):
    rows = frame(spark, enumerate(near(2, 900))).selectExpr("id as rep", "transform(embedding, x -> cast(x as float)) as v")
    held = fr.leaves(rows, Scratch(spark, "test"), trees=3, leaf=50).groupBy("node").count().collect()
    assert max(r["count"] for r in held) <= 50 and sum(r["count"] for r in held) == 2700


def test_copies_name_their_representative(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(600, [2.0, 4.0]), (700, [1.0, 2.1]), (800, [-1.0, 0.0])]
    odd = [(900, None), (901, []), (902, [0.0, 0.0]), (903, [None, 1.0]), (904, [float("nan"), 1.0]), (905, [float("inf"), 1.0]), (None, [1.0, 2.0]), (906, [1.0])]
    found = {(r["keep"], r["drop"]) for r in fr.consolidate(frame(spark, rows + odd), 0.95, leaf=4).collect()}
    assert found == {(0, i) for i in range(1, 500)} | {(0, 600), (0, 700)}
    assert fr.consolidate(frame(spark, odd[:3])).count() == 0
