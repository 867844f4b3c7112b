"""Registered queries take whole tables: fixtures with ids beyond any fixed bound, against brute force."""

import numpy as np
import pytest

from recollex.operators import packing as pk, vectors as vs
from recollex.plans import agent_queries as aq, graph_queries as gq, memory_queries as mq, scalar_queries as lq, search_queries as sq
from recollex.plans.models import graph, vectors


def customers(spark, path, keys):
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{path}/customer.parquet")
    return str(path)


def brute_edges(keys):
    return {(k, 2 * k + 1, "CAUSED", (k % 7 + 1) / 10) for k in keys} | {(k, 3 * k + 2, "MENTIONS" if k % 2 else "DEPENDS_ON", (k % 5 + 1) / 10) for k in keys}


def test_graph_has_all_customers(spark, tmp_path):
    keys = [*range(1, 21), *range(395, 420), 801, 5000]
    d = customers(spark, tmp_path, keys)
    want = brute_edges(keys)
    found = graph(spark, d).collect()
    assert len(found) == len(want) and {(r["from_id"], r["to_id"], r["rel"], r["weight"]) for r in found} == want
    assert {r["id"] for r in gq.QUERIES["so1_nodes"](spark, d).collect()} == {x for e in want for x in e[:2]}
    reach = {(a, b) for a, b, rel, _ in want if rel == "CAUSED"}
    step = dict(reach)
    while more := {(a, step[b]) for a, b in reach if b in step} - reach:
        reach |= more
    closure = gq.QUERIES["gr20_jn23_datalog_closure"](spark, d).collect()
    assert (400, 801) in reach and (400, 1603) in reach
    assert {(int(r["c0"]), int(r["c1"])) for r in closure} == reach


def embeddings(spark, path, ids, dim=64):
    x = np.random.default_rng(4).standard_normal((len(ids), dim)).round(3)
    x[1::3] = x[1]  # copies, so that ties decide
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path), x


def brute_nearest(ids, x, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - unit @ unit.T, 9)
    return {(q, rank + 1, i) for n, q in enumerate(ids) if q in queries for rank, (_, i) in enumerate(sorted(zip(d[n], ids, strict=True))[:k])}


def test_every_twentieth_vector_asks(spark, tmp_path):
    ids = [*range(100), 400, 401, 2000, 3001]
    d, x = embeddings(spark, tmp_path, ids)
    queries = {i for i in ids if i % 20 == 0}
    found = sq.QUERIES["vs1_ma2_knn_batch"](spark, d).collect()
    assert {(r["qid"], r["rank"], r["id"]) for r in found} == brute_nearest(ids, x, queries, 10) and len(found) == 10 * len(queries)
    edges = {(r["from_id"], r["to_id"]) for r in sq.QUERIES["jn19_neighbour_edges"](spark, d).collect()}
    want = {}
    for q, _, i in sorted(brute_nearest(ids, x, queries, 6)):
        if i != q and len(want.setdefault(q, [])) < 5:
            want[q].append(i)
    assert edges == {e for q, near in want.items() for i in near for e in ((q, i), (i, q))}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_knn_join_in_tiles_without_the_driver(spark, tmp_path, monkeypatch, limit):
    from pyspark.sql.classic.dataframe import DataFrame

    ids = list(range(90))
    d, x = embeddings(spark, tmp_path, ids)
    monkeypatch.setattr(vs, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(DataFrame, "toPandas", None)
    v = vectors(spark, d)
    odd = spark.createDataFrame([(1000, None), (1001, [1.0]), (1002, [None] + [1.0] * 63)], "id long, embedding array<float>")
    found = vs.knn_join(v.selectExpr("id as qid", "embedding"), v.select("id", "embedding").unionByName(odd), 7, dim=64, block=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("CartesianProduct" in plan) == (limit == 0) and "WindowGroupLimit" in plan
    assert {(r["qid"], r["rank"], r["id"]) for r in found.collect()} == brute_nearest(ids, x, set(ids), 7)
    assert vs.knn_join(v.selectExpr("id as qid", "embedding").limit(0), v, 7, dim=64).count() == 0


def documents(spark, path, rows):
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_all_documents_are_packed_and_ranked(spark, tmp_path):
    ids = [*range(48, 52), 199, 200, 299, 300, 399, 400, 5000]
    words = [" ".join(f"w{i}x{j}" for j in range(8)) + "." for i in ids]
    d = documents(spark, tmp_path, zip(ids, words, strict=True))
    packed = mq.QUERIES["cx1_pack"](spark, d).collect()
    assert {(r["qid"], r["id"]) for r in packed} == {(i // 50, i) for i in ids}
    assert {r["id"]: r["text"] for r in pk.pack(mq._candidates(spark, d)).collect()} == {i: w for i, w in zip(ids, words, strict=True)}
    assert {r["id"] for r in mq.QUERIES["ma20_mmr"](spark, d).collect()} == set(ids)
    assert {r["qid"] for r in mq._gold(spark, d)[0].collect()} == set(ids)
    for name in ("sl14_rank_hits", "wn11_take_while_fits", "wn12_serial_order", "wn13_cache_stable_order", "cx4_context_pack"):
        query = (aq.QUERIES | sq.QUERIES)[name]
        assert {r["id"] for r in query(spark, d).collect()} == set(ids), name


def test_whole_texts_and_all_terms(spark, tmp_path):
    filler = "lower " * 100
    d = documents(spark, tmp_path, [(1, f"Alpha {filler} Zeta."), (900, f"Alpha {filler} Omega.")])
    found = {(r["from_entity"], r["to_entity"]) for r in gq.QUERIES["gr14_jn18_entity_graph"](spark, d).collect()}
    assert found == {("Alpha", "Zeta"), ("Zeta", "Alpha"), ("Alpha", "Omega"), ("Omega", "Alpha")}
    rows, mentions = aq._mentions(spark, d)
    assert {(r["id"], r["entity"]) for r in mentions.collect()} == {(1, "Alpha"), (1, "Zeta"), (900, "Alpha"), (900, "Omega")}
    terms = {r["term"]: r["cf"] for r in sq.QUERIES["ft1_postings"](spark, d).collect()}
    assert (terms["lower"], terms["omega"]) == (400, 2)  # title and text
    spark.createDataFrame([(1, "u", "<a>" * 500)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    assert lq.QUERIES["sf7_xml_escape"](spark, d).first()["xml"] == "&lt;a&gt;" * 500
