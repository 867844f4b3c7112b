"""Cells with spheres: exact answers from few cells, before and after changes, and odd vectors."""

import numpy as np
import pytest

from recollex.operators import vectorindex as vi

ROW = "id long, embedding array<float>"


def _groups(groups, each, dim, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    return (middle[np.repeat(np.arange(groups), each)] + 0.05 * rng.normal(size=(groups * each, dim))).astype(np.float32)


def _want(rows, query, k):
    q = np.asarray(query, float)
    found = []
    for i, v in rows.items():
        v = np.asarray(v, float)
        size = np.linalg.norm(v) * np.linalg.norm(q)
        found.append((round(1 - (v @ q / size if size > 0 else 0.0), 9), i))
    return [i for _, i in sorted(found)[:k]]


@pytest.mark.parametrize("storage", ["f32", "f16"])
def test_proven_answers_open_few_cells(spark, tmp_path, storage):
    x = _groups(24, 40, 16)
    rows = {i: v.tolist() for i, v in enumerate(x)}
    index = vi.CellIndex(spark, f"{tmp_path}/i", storage=storage, probes=1).build(spark.createDataFrame(list(rows.items()), ROW), 24)
    index.insert(spark.createDataFrame([(5, x[900].tolist()), (5000, (-x[3]).tolist()), (5001, [0.0] * 16)], ROW))
    index.remove(spark.createDataFrame([(41,), (901,)], "id long"))
    rows |= {5: x[900].tolist(), 5000: (-x[3]).tolist(), 5001: [0.0] * 16}
    del rows[41], rows[901]
    half = {i: np.asarray(v, np.float16).tolist() for i, v in rows.items()} if storage == "f16" else rows
    opened = 0
    for number in (3, 410, 902):
        query = [float(v) for v in x[number]]
        found, cells = index.proven(query, 10)
        assert [r["id"] for r in found.collect()] == _want(half, query, 10)
        opened += len(cells)
    assert opened <= 3 * 24 / 4
    # More than a group holds: further cells are opened, up to all.
    query = [float(v) for v in x[3]]
    assert [r["id"] for r in index.proven(query, 70)[0].collect()] == _want(half, query, 70)
    found, cells = index.proven(query, 5000)
    assert len(found.collect()) == len(rows)
    assert index.proven([0.0] * 16, 3)[0].count() == 0


def test_odd_vectors_are_held_but_not_found(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], ROW)
    index = vi.CellIndex(spark, f"{tmp_path}/i").build(rows, 3)
    index.insert(spark.createDataFrame([(100, None), (101, [1.0]), (102, [None, 1.0]), (103, [float("nan"), 1.0])], ROW))
    assert index.size() == 34
    found, _ = index.proven([1.0, 1.0], 50)
    assert sorted(r["id"] for r in found.collect()) == list(range(30))
    with pytest.raises(ValueError, match="f32"):
        vi.CellIndex(spark, f"{tmp_path}/j", storage="i8").proven([1.0], 1)


def test_half_storage_of_numbers_near_nothing(spark, tmp_path):
    tiny = [(i, [3e-8 * (1 + i % 4), 1e-8 * (i % 3)]) for i in range(20)]
    far = [(100 + i, [-1.0 - i / 40, 0.5]) for i in range(20)]
    index = vi.CellIndex(spark, f"{tmp_path}/i", storage="f16", probes=1).build(spark.createDataFrame(tiny + far, ROW), 2)
    index.insert(spark.createDataFrame([(500, [2.0, -1.0])], ROW))
    query = [1.0, 0.7]
    exact = index.search(query, 12, probes=2).collect()
    assert [(r["id"], r["distance"]) for r in index.proven(query, 12)[0].collect()] == [(r["id"], r["distance"]) for r in exact]


def test_tiers_free_what_they_cached(spark):
    rows = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(12)], ROW)
    with vi.TieredIndex(rows, hot=4) as index:
        before = [r["id"] for r in index.search([1.0, 0.0], 5).collect()]
        assert index.hot.storageLevel.useMemory
    assert not index.hot.storageLevel.useMemory
    assert before == [r["id"] for r in index.search([1.0, 0.0], 5).collect()] == [11, 10, 9, 8, 7]
