import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.llm import centroid_clusters as cc

from .helpers import rows


def vectors(spark, found):
    return spark.createDataFrame(found, "vec_id long, embedding array<float>")


def brute(found, clusters=16, rounds=3, dim=64, scale=64):
    keys = [k for k, _ in found]
    x = [[int(np.floor(scale * float(np.float32(c)))) for c in v] for _, v in found]
    first = sorted((hashlib.sha256(f"1:{k}".encode()).hexdigest(), v) for k, v in zip(keys, x, strict=True) if k is not None)[:clusters]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for v in x]
        for i in range(len(centroids)):
            own = [v for v, a in zip(x, at, strict=True) if a == i]
            if own:
                centroids[i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [nearest(v) for v in x]
    total = {i: sum(d for d, j in last if j == i) for i in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(k, j, d, total[j], sum(total.values()), names[j]) for k, (d, j) in zip(keys, last, strict=True)], key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("n, dim, clusters, spread", [(300, 3, 16, 1.0), (120, 2, 40, 0.1), (10, 4, 16, 1.0), (200, 5, 1, 2.0)])
def test_against_brute_force_with_ties(spark, n, dim, clusters, spread):
    rng = np.random.default_rng(n + dim)
    # A coarse grid makes many ties and copies.
    found = [(i, (np.round(rng.normal(size=dim) * spread * 4) / 4).tolist()) for i in range(n)]
    got = cc.cluster(vectors(spark, found), clusters=clusters, dim=dim, scale=4)
    assert rows(got, *COLUMNS) == brute(found, clusters, dim=dim, scale=4)


def test_hot_vector_and_equal_starts(spark):
    found = [(i, [0.5, 0.25]) for i in range(200)] + [(1000 + i, [float(i), -float(i)]) for i in range(50)]
    assert rows(cc.cluster(vectors(spark, found), dim=2, scale=64), *COLUMNS) == brute(found, dim=2)


def test_annulus_holds_the_nearest_and_few_others():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (500, 2))
    x = rng.integers(-1000, 1000, (400, 2))
    index = cc.Annuli(centroids)
    first, last = index.candidates(x)
    apart = ((x[:, None, :] - centroids[None]) ** 2).sum(-1)
    number, distance = index.nearest(x)
    assert number.tolist() == apart.argmin(1).tolist() and distance.tolist() == apart.min(1).tolist()
    assert (last - first).mean() < 0.4 * len(centroids)


def test_border_ties_are_inside():
    # All centroids lie on one circle around the origin, as far from it as each other.
    centroids = np.array([[0, 5], [3, 4], [5, 0], [-5, 0], [4, 3]])
    number, distance = cc.Annuli(centroids).nearest(np.array([[0, 0], [0, 0], [10, 0]]))
    assert number.tolist() == [0, 0, 2] and distance.tolist() == [25, 25, 25]


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    fine = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [3.0, 3.0]), (4, [-0.0, 0.0])]
    odd = [(5, None), (6, []), (7, [1.0]), (8, [1.0, None]), (9, [nan, 1.0]), (10, [1.0, -inf])]
    frame = vectors(spark, fine + odd).selectExpr("*", "1 as cluster", "2 as x", "3 as key", "4 as distance")
    assert rows(cc.cluster(frame, dim=2), *COLUMNS) == brute(fine, dim=2)
    assert cc.cluster(frame.limit(0), dim=2).count() == 0
    assert cc.cluster(frame.filter("vec_id > 4"), dim=2).columns == list(COLUMNS)
    with pytest.raises(Exception, match="beyond"):
        cc.cluster(vectors(spark, [(1, [1e7, 0.0])]), dim=2).count()
    with pytest.raises(ValueError, match="driver"):
        cc.fit(frame, clusters=1 << 22)


def test_no_vector_is_shuffled(spark):
    vecs = cc.kept(spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0)).alias("embedding")), key="vec_id", vector="embedding", dim=2)
    plan = cc.assign(vecs, np.array([[0, 0], [500, 64]]))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
