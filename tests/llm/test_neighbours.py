import numpy as np
from pyspark.sql import functions as F

from recollex.llm import neighbour_graph as ng
from recollex.llm import queries as Q


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = sorted((float(d[i]), int(ids[i])) for i in range(len(ids)) if i != q)
    return order[:k]


def test_query_recall_and_exact_scores(spark):
    folder = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(t["embedding"]).astype(float), t["vec_id"].to_numpy()
    found = Q.op5_neighbours(spark, folder).toPandas()
    hits = 0
    for q, part in found.groupby("query_id"):
        part = part.sort_values("rank")
        at = int(np.flatnonzero(ids == q)[0])
        assert list(part["rank"]) == list(range(1, 11)) and q not in set(part["vec_id"])
        own = [float(np.sqrt(((x[np.flatnonzero(ids == v)[0]] - x[at]) ** 2).sum())) for v in part["vec_id"]]
        assert np.allclose(own, part["score"], rtol=1e-12)
        assert list(zip(part["score"], part["vec_id"], strict=True)) == sorted(zip(part["score"], part["vec_id"], strict=True))
        hits += len({v for _, v in brute(ids, x, at, 10)} & set(part["vec_id"]))
    assert found["query_id"].nunique() == 20 and hits / 200 >= 0.9


def test_copies_ties_and_odd_rows(spark):
    same = [float(i) for i in range(1, 5)]
    rows = [(i, same) for i in range(0, 60)] + [(100, [1.0, 2.0, 3.0, 5.0]), (101, [9.0, 9.0, 9.0, 9.0]), (101, [9.0, 9.0, 9.0, 9.0])]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 1.0, 1.0]), (203, [1.0, float("nan"), 1.0, 1.0]), (204, [1.0, float("inf"), 1.0, 1.0]), (205, [1.0]), (None, same), (206, [])]
    frame = vectors(spark, rows).selectExpr("*", "1 as u", "2 as v", "3 as id")
    found = ng.Index(frame).neighbours(F.col("id").isin(0, 100, 205), 10).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [v for v, _ in by[0]] == list(range(1, 11)) and all(s == 0 for _, s in by[0])
    assert [v for v, _ in by[100]] == list(range(0, 10)) and all(s == 1 for _, s in by[100])
    assert 205 not in by
    exact = ng.Index(frame).neighbours(F.col("id").isin(0, 100, 205), 10, exact=True)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, found))


def test_ids_that_clash_and_dimensions_that_differ(spark):
    frame = vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [5.0, 5.0]), (7, [1.0]), (8, [2.0]), (9, [4.0])])
    found = ng.Index(frame).neighbours(F.col("id").isin(0, 7), 10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], round(r["score"], 3)) for r in found] == [(0, 1, 1.0), (0, 1, 1.414), (0, 2, 6.403), (7, 8, 1.0), (7, 9, 3.0)]


def test_recall_on_tight_groups_and_the_exact_way(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16)) * 5
    x = (centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16)) * 0.05).astype(np.float32)
    index = ng.Index(vectors(spark, [(i, [float(a) for a in v]) for i, v in enumerate(x)]))
    ids = np.arange(3000)
    asked = F.col("id") % 100 == 0
    for exact, least in ((False, 0.95), (True, 1.0)):
        hits = 0
        for q, part in index.neighbours(asked, 10, exact=exact).toPandas().groupby("query_id"):
            hits += len({v for _, v in brute(ids, x.astype(float), q, 10)} & set(part["vec_id"]))
        assert hits / 300 >= least


def test_few_and_no_rows(spark):
    few = ng.Index(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])).neighbours(F.col("id") == 0, 10)
    assert [(r["vec_id"], r["rank"]) for r in few.orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert ng.Index(vectors(spark, [])).neighbours(F.col("id") >= 0, 10).count() == 0
    alone = ng.Index(vectors(spark, [(0, [1.0, 0.0])])).neighbours(F.col("id") == 0, 10)
    assert alone.count() == 0
