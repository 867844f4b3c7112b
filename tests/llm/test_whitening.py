import numpy as np
import pytest

from recollex.llm import queries as Q
from recollex.llm import whitening as wh

from .helpers import rows


def vectors(spark, found):
    return spark.createDataFrame(found, "vec_id long, embedding array<float>")


def brute(x, k):
    """Mean, axes and eigenvalues of the distinct rows, and each row's values."""
    fit = np.unique(x, axis=0).astype(np.longdouble)
    mean = fit.mean(0)
    c = (fit - mean).T @ (fit - mean) / len(fit)
    e, v = np.linalg.eigh(c.astype(float))
    order = np.argsort(-e)[:k]
    return len(fit), ((x - mean).astype(float) @ v[:, order]) / np.sqrt(e[order]), e[order] / e.sum()


def test_query_against_brute_force(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.floor(256 * np.stack(t["embedding"]).astype(float)).astype(np.int64)
    n, w, share = brute(x, 4)
    found = Q.op11_whitening(spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    assert list(found.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(found) == 4 * len(t) and set(found["n"]) == {n}
    own = found["whitened"].to_numpy().reshape(-1, 4)
    for k in range(4):
        sign = np.sign(own[:, k] @ w[:, k])
        assert np.allclose(own[:, k], sign * w[:, k], atol=1e-9)
    assert np.allclose(found["explained"].to_numpy().reshape(-1, 4), share, rtol=1e-9)
    sums = np.unique(x, axis=0).sum(0)
    assert list(found["deviation"][::1])[::4] == ((n * x - sums) ** 2).sum(1).tolist()
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9


@pytest.mark.parametrize("cuts", [[1], [7, 8], [100, 101, 350]])
def test_merging_parts_is_the_whole(cuts):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(400, 5)) * 1000 + 10**6).astype(np.int64)
    whole = wh.moments_of(x)
    parts = [wh.moments_of(p) for p in np.split(x, cuts)]
    left = right = parts[0]
    for p in parts[1:]:
        left, right = wh.merge(left, p), wh.merge(p, right)
    for got in (left, right):
        assert got.n == 400 and list(got.sums) == list(whole.sums)
        assert np.allclose(got.scatter, whole.scatter, rtol=0, atol=1e-13 * np.trace(whole.scatter)) and np.allclose(got.mean, whole.mean, rtol=1e-14)


def test_copies_count_once_and_a_hot_vector_moves_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 3)).astype(np.float32)
    one = vectors(spark, [(i, v.tolist()) for i, v in enumerate(base)])
    hot = vectors(spark, [(i, v.tolist()) for i, v in enumerate([*base, *[base[0]] * 400])])
    a, b = wh.fit(one).lengths[3], wh.fit(hot).lengths[3]
    assert a.n == b.n == 60 and list(a.sums) == list(b.sums) and np.allclose(a.values, b.values)
    assert wh.whiten(hot, wh.fit(hot)).count() == 460


def test_odd_rows_and_lengths(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, nan]), (5, [inf, 1.0])]
    two = [(10, [0.0, 0.5]), (11, [1.0, 0.0]), (12, [2.0, 3.0]), (12, [2.0, 3.0]), (None, [-1.0, -0.0])]
    three = [(20, [1.0, 2.0, 3.0]), (21, [1.0, 2.0, 4.0])]
    frame = vectors(spark, odd + two + three + [(30, [5.0])]).selectExpr("*", "1 as x", "2 as n", "3 as whitening", "4 as part")
    model = wh.fit(frame)
    assert set(model.lengths) == {2, 3} and model.lengths[2].n == 4 and len(model.lengths[3].values) == 1
    assert model.identity_error < 1e-9
    found = rows(wh.whiten(frame, model).selectExpr("vec_id", "x", "whitening.length as length", "size(whitening.whitened) as k"), "vec_id", "x", "length", "k")
    assert found == sorted([(10, 1, 2, 2), (11, 1, 2, 2), (12, 1, 2, 2), (12, 1, 2, 2), (None, 1, 2, 2), (20, 1, 3, 1), (21, 1, 3, 1), (30, 1, 1, 0)], key=repr)
    empty = frame.filter("vec_id < 6")
    assert wh.fit(empty).lengths == {} and wh.whiten(empty, wh.fit(empty)).count() == 0
    assert wh.whiten(frame.limit(0), wh.fit(frame.limit(0))).count() == 0


def test_huge_components_stay_exact(spark):
    frame = vectors(spark, [(1, [1e30, 1.0]), (2, [3.0e12, -2.0]), (3, [5.0, 7.0])])
    model = wh.fit(frame)
    top, axes = 2**63 - 1, model.lengths[2]
    assert list(axes.sums) == [top + int(256 * np.float64(np.float32(3.0e12))) + 1280, 256 - 512 + 1792]
    found = {r["vec_id"]: r["w"]["deviation"] for r in wh.whiten(frame, model, out="w").collect()}
    grid = {2: [int(256 * np.float64(np.float32(3.0e12))), -512], 3: [1280, 1792]}
    for key, g in grid.items():
        want = sum((3 * x - s) ** 2 for x, s in zip(g, axes.sums, strict=True))
        assert found[key] is None if want >= 10**38 else int(found[key]) == want
