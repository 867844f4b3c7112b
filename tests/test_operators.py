"""Operators on tiny hand-made frames."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollex.functions import time as tm
from recollex.functions.porter import stem
from recollex.operators import cypher, datalog, fulltext, fusion, graph, learning, memory, packing, predicates as pr, vectors

EDGES = "from_id long, to_id long, rel string, weight double"
NOW = 1_709_208_000  # 2024-02-29


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def test_porter():
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "agreed": "agre", "happy": "happi", "generalizations": "gener", "a": "a", "sky": "sky", "adoption": "adopt"}
    assert {w: stem(w) for w in words} == words


@pytest.mark.parametrize(
    ("phrase", "first", "last"),
    [("on 2024-01-15", "2024-01-15", "2024-01-15"), ("gestern", "2024-02-28", "2024-02-28"), ("3 days ago", "2024-02-26", "2024-02-26"), ("vor 2 wochen", "2024-02-15", "2024-02-15"), ("last week", "2024-02-19", "2024-02-25"), ("last month", "2024-01-01", "2024-01-31"), ("Q1 2023", "2023-01-01", "2023-03-31"), ("im märz", "2024-03-01", "2024-03-31"), ("february 2023", "2023-02-01", "2023-02-28"), ("last year", "2023-01-01", "2023-12-31")],
)
def test_periods(phrase, first, last):
    import calendar
    import datetime as dt

    at = lambda d: calendar.timegm(dt.date.fromisoformat(d).timetuple())
    assert tm.parse_period(phrase, NOW) == (at(first), at(last) + 86399)


def test_no_period_and_relative():
    assert tm.parse_period("nothing here", NOW) is None
    assert tm.parse_relative("last week", NOW) == (NOW - 6 * 86400, NOW)


def test_predicates_have_two_values(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": 1.0}'), (3, '{"a": "1"}'), (4, None), (5, "{bad"), (6, '{"b": null}')], "id long, meta string")
    ids = lambda p: [r["id"] for r in pr.filtered(rows, p).orderBy("id").collect()]
    assert ids(pr.eq("a", 1)) == [1] and ids(pr.eq("a", "1")) == [3] and ids(pr.eq("a", 1.0)) == [2]
    assert ids(pr.ne("a", 1)) == [2, 3] and ids(~pr.eq("a", 1)) == [2, 3, 4, 5, 6]
    assert ids(pr.gte("a", 1)) == [1, 2] and ids(pr.within("b", ["x", "y"])) == [1] and ids(pr.eq("a", 1) | pr.eq("a", "1")) == [1, 3]
    assert pr.selectivity(pr.eq("a", 1) & pr.gt("a", 1)) == pytest.approx(0.15) and pr.oversample(pr.ne("a", 1)) == 2


def test_query_compiler():
    assert fulltext.compile_query("  ") is None
    assert fulltext.compile_query("two words") == fulltext.Query(("two", "words"), True)
    assert fulltext.compile_query("a-b c?") == fulltext.Query((), False)
    assert not fulltext.compile_query("one OR two").all_terms


def test_stemmed_search_and_blank(spark):
    docs = spark.createDataFrame([(1, "", "hopping hops", "u", 1), (2, "", "nothing", "u", 2)], "id long, title string, text string, uri string, ts long")
    assert [r["id"] for r in fulltext.search(docs, "hop", 5, stem=True).collect()] == [1]
    assert fulltext.search(docs, " ", 5).count() == 0
    assert fulltext.best_effort(docs, "absent", 1)[0] == "timeline"


def test_graph_on_small_shapes(spark):
    star = edges(spark, [(i, 0, "r", 1.0) for i in range(1, 6)])
    ranks = {r["id"]: r["score"] for r in graph.pagerank(star).collect()}
    assert max(ranks, key=ranks.get) == 0 and sum(ranks.values()) == pytest.approx(1)
    two = edges(spark, [(1, 2, "r", 1.0), (2, 3, "r", 1.0), (3, 1, "r", 1.0), (11, 12, "r", 1.0), (12, 13, "r", 1.0), (13, 11, "r", 1.0)])
    assert all(r["settled"] for r in graph.communities(two).collect())
    labels = {r["id"]: r["label"] for r in graph.communities(two).collect()}
    assert len({labels[i] for i in (1, 2, 3)}) == 1 and labels[1] != labels[11]
    detour = edges(spark, [(1, 3, "r", 0.1), (1, 2, "r", 0.9), (2, 3, "r", 0.9)])
    best = graph.shortest_path(detour, 1, 3, 4).first()
    assert best["path"] == [1, 2, 3] and best["cost"] == pytest.approx(0.2)
    assert graph.shortest_path(detour, 3, 1, 4).count() == 0
    assert graph.pagerank(star.limit(0)).count() == 0
    assert {r["id"]: r["component"] for r in graph.components(two).collect()}[13] == 11


def test_personalized_pagerank_keeps_mass(spark):
    e = edges(spark, [(1, 2, "r", 3.0), (1, 3, "r", 1.0)])
    seeds = spark.createDataFrame([(1, 1.0)], "id long, score double")
    got = {r["id"]: r["score"] for r in graph.personalized_pagerank(e, seeds).collect()}
    assert got[2] > got[3] and sum(got.values()) == pytest.approx(1)
    lone = graph.personalized_pagerank(e, spark.createDataFrame([(9, 2.0)], "id long, score double")).collect()
    assert [(r["id"], round(r["score"], 9)) for r in lone] == [(9, 1.0)]
    assert graph.personalized_pagerank(e, seeds.limit(0)).count() == 0


def test_why_and_depths(spark):
    rows = spark.createDataFrame([("a", "b", "caused"), ("b", "c", "caused"), ("x", "c", "mentions"), ("c", "a", "caused")], "from_uri string, to_uri string, rel string")
    got = lambda n: [(r["uri"], r["depth"]) for r in graph.why(rows, "c", n).collect()]
    assert got(1) == [("c", 0)] and got(2) == [("c", 0), ("b", 1)] and got(9) == [("c", 0), ("b", 1), ("a", 2)] and got(0) == []
    assert graph.why(rows, "nowhere", 3).count() == 0


def test_datalog_chain_and_constants(spark):
    p = datalog.Program(spark)
    p.add_facts("parent", spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "x string, y string"))
    p.add_rule("anc(X, Y) :- parent(X, Y).")
    p.add_rule("anc(X, Z) :- anc(X, Y), parent(Y, Z).")
    p.add_rule("of_a(Y) :- anc(a, Y).")
    p.run()
    assert p.query("anc").count() == 6 and sorted(r["c0"] for r in p.query("of_a").collect()) == ["b", "c", "d"]
    with pytest.raises(ValueError):
        datalog.parse_rule("h(X) :- b(Y).")


def test_cypher(spark):
    assert cypher.parse("MATCH (a)-[:knows]->(b) WHERE id(a) = 5 RETURN b")["rel"] == "KNOWS"
    e = edges(spark, [(1, 2, "KNOWS", 1.0), (2, 3, "KNOWS", 1.0)])
    assert cypher.run(e, "CREATE (3)-[:knows {weight: 0.5}]->(4)").count() == 3
    assert cypher.run(e, "SHORTEST PATH FROM 1 TO 3").first()["path"] == [1, 2, 3]
    assert cypher.run(e, "CALL pagerank(2)").count() == 2
    with pytest.raises(ValueError):
        cypher.parse("DELETE everything")


def test_packing(spark):
    rows = [(0, i, "fact", 1.0 - i / 100, f"word{i} " * 40) for i in range(30)] + [(0, 99, "fact", 0.5, "word3 " * 40), (1, 5, "code", 0.9, "x " * 9000)]
    c = spark.createDataFrame(rows, "qid long, id long, kind string, score double, text string")
    out = packing.pack(c, packing.PackOptions(budget=600)).toPandas()
    assert out[out.qid == 0].tokens.sum() <= 600 - 150 and 99 not in set(out.id)
    assert len(out[out.qid == 1]) == 1
    assert packing.simhash("") == 0 and packing.simhash("a b") == packing.simhash("A  B")
    assert packing.shrunk_budget(2000, 3) == 1200 and packing.shrunk_budget(1000, 6) == 512


def test_serial_order(spark):
    rows = spark.range(5).select(F.col("id"), (F.col("id") + 1).alias("rank"))
    assert [r["rank"] for r in fusion.serial_order(rows).orderBy("position").collect()] == [1, 3, 4, 5, 2]


@given(st.lists(st.tuples(st.integers(0, 20), st.floats(0, 1)), min_size=1, max_size=15))
@settings(max_examples=10, deadline=None)
def test_fusion_ignores_the_order_of_rows(spark, rows):
    frame = spark.createDataFrame(rows, "id long, score double").dropDuplicates(["id"])
    a = fusion.rrf([fusion.ranked(frame, "x")], 5).collect()
    b = fusion.rrf([fusion.ranked(frame.orderBy(F.desc("id")), "x")], 5).collect()
    assert a == b and {r["id"] for r in a} <= {r["id"] for r in fusion.rrf([fusion.ranked(frame, "x")]).collect()}


def test_vector_searches_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, embedding array<float>")
    exact = np.argsort(1 - x @ x[7] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[7])), kind="stable")[:10]
    q = [float(t) for t in x[7]]
    assert [r["id"] for r in vectors.knn(v, q, 10).collect()] == list(exact)
    assert vectors.cascade(v, q, 10, first=300).first()["id"] == 7
    assert len({r["id"] for r in vectors.int8_knn(v, q, 10).collect()} & set(exact)) >= 8
    assert len({r["id"] for r in vectors.rotated_knn(v, q, 10, pool=150).collect()} & set(exact)) >= 8
    assert vectors.knn(v, [0.0] * 16, 5).count() == 0 and vectors.knn(v, [1.0], 5).count() == 0
    from recollex.storage import new_path

    path = new_path(spark, "ivf")
    centres = vectors.ivf_build(v, 4, path)
    assert [r["id"] for r in vectors.ivf_search(spark, path, centres, q, 10, probes=4).collect()] == list(exact)
    assert vectors.ivf_search(spark, path, centres, q, 1, probes=1).first()["id"] == 7


def test_similar_pairs_by_prefix_lose_nothing(spark):
    texts = ["alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta", "other words here", "alpha beta gamma", "", "alpha beta gamma delta epsilon"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for t in (0.5, 0.8, 1.0):
        sets = [{w for w in x.split() if len(w) > 2} for x in texts]
        want = {(a, b) for a in range(6) for b in range(a + 1, 6) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        rep = {r["id"]: r["rep"] for r in memory.text_groups(rows).collect()}
        assert {(r["a"], r["b"]) for r in memory.similar_pairs(rows, t).collect()} == {(a, b) for a, b in want if rep[a] == a and rep[b] == b}
        assert all(tuple(sorted((rep[a], rep[b]))) in want or rep[a] == rep[b] for a, b in want)


def test_learning():
    assert learning.pick({"a": (1000, 1), "b": (1, 1000)}, ["a", "b"], 0) == "a" and learning.pick({}, [], 0) is None
    assert learning.pick_alpha({}, 3, 1)[1] in learning.ALPHAS
