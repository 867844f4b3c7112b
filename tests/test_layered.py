"""The layered graph index against brute force: recall, what is read, inserts, removals, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.operators.layered import LayeredIndex, diverse
from recollex.storage import Scratch

ROW = "id long, embedding array<float>"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v]) for i, v in zip(ids, x, strict=True)], ROW)


def groups(n, seed, dim=24, centres=80):
    rng = np.random.default_rng(seed)
    c = np.random.default_rng(99).standard_normal((centres, dim))
    return (c[rng.integers(0, centres, n)] + 0.35 * rng.standard_normal((n, dim))).astype(np.float32)


def recall(spark, index, ids, x, asked, k=10, **options):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    queries = spark.createDataFrame([(int(n), asked[n].tolist()) for n in range(len(asked))], "qid long, embedding array<double>")
    got = {}
    for r in index.search_batch(queries, k, **options).collect():
        got.setdefault(r["qid"], set()).add(r["id"])
    hits = 0
    for n, q in enumerate(asked):
        d = 1 - unit @ (q / np.linalg.norm(q))
        hits += len(got[n] & set(np.asarray(ids)[np.argsort(d, kind="stable")[:k]].tolist()))
    return hits / (k * len(asked)), index.compared(queries, k, **options)


def test_recall_and_reading_before_and_after_changes(spark, tmp_path):
    x = groups(6000, 1)
    ids = np.arange(6000)
    index = LayeredIndex(spark, str(tmp_path), fan=16, routes=4, beam=20, step=8, top=32).build(frame(spark, ids[:5000], x[:5000]))
    asked = groups(40, 2)
    found, read = recall(spark, index, ids[:5000], x[:5000], asked)
    assert found >= 0.95 and read < 0.1
    index.insert(frame(spark, ids[5000:], x[5000:]))
    found, read = recall(spark, index, ids, x, asked)
    assert found >= 0.95 and read < 0.1
    gone = ids % 4 == 1
    index.remove(frame(spark, ids[gone], x[gone]))
    found, read = recall(spark, index, ids[~gone], x[~gone], asked)
    assert found >= 0.95 and read < 0.1
    links = index.links()
    assert links.join(index.nodes().select(F.col("nid").alias("v")), "v", "left_anti").count() == 0
    assert links.groupBy("level", "u").count().agg({"count": "max"}).first()[0] <= 32
    index.rebuild()
    assert len(index.commits()) == 1 and recall(spark, index, ids[~gone], x[~gone], asked)[0] >= 0.95


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_few_rows_are_exact_and_odd_ones_stay_out(spark, tmp_path, metric):
    nan, inf = float("nan"), float("inf")
    index = LayeredIndex(spark, str(tmp_path), metric=metric)
    assert index.search([1.0, 0.0], 3).count() == 0
    rows = {1: [1, 0], 2: [0, 1], 3: [1, 1], 4: [1, 0], 5: [3, 0], 6: [-1, 0.5]}
    odd = {7: None, 8: [nan, 1], 9: [inf, 1], 10: [None, 1], 11: []} | ({12: [0, 0]} if metric == "cosine" else {})
    index.build(frame(spark, [*rows, *odd], [*rows.values(), *odd.values()]).selectExpr("*", "1 as v", "2 as nid", "3 as level"))

    def want(held):
        q = np.array([1.0, 0.2])
        def d(v):
            v = np.array(v, float)
            return 1 - v @ q / np.linalg.norm(v) / np.linalg.norm(q) if metric == "cosine" else np.linalg.norm(v - q)
        return [i for _, i in sorted((round(float(d(v)), 6), i) for i, v in held.items())[:4]]

    assert [r["id"] for r in index.search([1.0, 0.2], 4).collect()] == want(rows)
    # Another vector for 1, whose node 4 still needs; a new row; then both rows of a node go.
    index.insert(frame(spark, [1, 20], [[0.9, 0.3], [1, 0]]))
    rows |= {1: [0.9, 0.3], 20: [1, 0]}
    assert [r["id"] for r in index.search([1.0, 0.2], 4).collect()] == want(rows)
    index.remove(frame(spark, [4, 20, 99], [[1, 0]] * 3))
    for i in (4, 20):
        rows.pop(i)
    assert [r["id"] for r in index.search([1.0, 0.2], 4).collect()] == want(rows)
    index.remove(frame(spark, list(rows), list(rows.values())))
    assert index.search([1.0, 0.2], 4).count() == 0
    index.insert(frame(spark, [1], [[1, 1]]))
    assert [r["id"] for r in index.search([1.0, 0.2], 4).collect()] == [1]


def test_a_vector_that_half_of_the_rows_have(spark, tmp_path):
    x = groups(800, 3)
    x[400:] = x[0]
    index = LayeredIndex(spark, str(tmp_path)).build(frame(spark, np.arange(800), x))
    assert index.nodes().count() == 400 and index.rows().count() == 800
    found = [r["id"] for r in index.search(x[0].tolist(), 12).collect()]
    assert found == [0, *range(400, 411)]


def test_links_point_in_different_directions():
    # Of three points on a line, the far one is reached through the near one.
    x = np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 3.0]])
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    linked = [set(row[row >= 0].tolist()) for row in diverse(d, 3)]
    assert linked[0] == {1, 3} and linked[2] == {1}


def test_search_reads_no_vectors_of_other_cells_at_once(spark, tmp_path):
    index = LayeredIndex(spark, str(tmp_path), fan=16, routes=4).build(frame(spark, np.arange(600), groups(600, 5)))
    assert index.commits()[-1]["top"] == 1 and index.nodes().filter("level >= 1").count() <= 64
    # A node's cells are those of its nearest centres.
    cells = index.cells().filter("level = 1").groupBy("nid").count().collect()
    assert {r["count"] for r in cells} == {4} and len(cells) == 600


def test_a_search_keeps_one_row_for_each_query(spark, tmp_path, monkeypatch):
    x = groups(1500, 5)
    index = LayeredIndex(spark, str(tmp_path), fan=16, routes=4, beam=20, step=8, top=32).build(frame(spark, range(1500), x))
    written, write = {}, Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    queries = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(groups(10, 6))], "qid long, embedding array<double>")
    assert index.search_batch(queries, 10).count() == 100
    of_graph = {"nodes", "steps"}
    assert max(n for name, n in written.items() if name not in of_graph) == 10
