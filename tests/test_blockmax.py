"""Block-max search against all sums of products."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.operators import vectors as vs
from recollex.operators.blockmax import BlockMaxIndex

ROW, ASKED = "id long, term string, weight double", "qid long, term string, q double"


def brute(rows, queries, k):
    held = {}
    for i, t, w in rows:
        held.setdefault(i, {}).setdefault(t, 0.0)
        held[i][t] += w
    asked = {}
    for q, t, w in queries:
        asked.setdefault(q, {})[t] = w
    out = set()
    for q, terms in asked.items():
        found = [(-round(sum(w * terms[t] for t, w in own.items() if t in terms), 9), i) for i, own in held.items() if any(t in terms and w for t, w in own.items())]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])}
    return out


def answers(df):
    return {(r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect()}


def corpus(n, terms, seed, low=0.0):
    """Weights with a heavy tail; one term that all documents have."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size = rng.pareto(1.5) + 0.2
        for t in rng.choice(terms, rng.integers(2, 9), replace=False):
            rows.append((i, f"t{t}", float(np.round(size * rng.random() + low, 3))))
        rows.append((i, "all", float(np.round(size / 4, 3))))
    return [r for r in rows if r[2]]


def test_exact_and_skips_most_blocks(spark, tmp_path):
    rows = corpus(3000, 60, 1)
    index = BlockMaxIndex(spark, str(tmp_path), block=16).add(spark.createDataFrame(rows, ROW))
    queries = [(q, t, w) for q in range(6) for t, w in ((f"t{q}", 1.0), (f"t{q + 10}", 0.5), ("all", 0.2))]
    asked = spark.createDataFrame(queries, ASKED)
    assert answers(index.search_batch(asked, 10)) == brute(rows, queries, 10)
    blocks, opened = index.work(asked, 10)
    assert blocks > 1000 and opened < 0.25 * blocks


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_negative_weights_ties_and_more_asked_for_than_there_is(spark, tmp_path, k):
    rows = [(i, t, round(w - 0.7, 1)) for i, t, w in corpus(300, 12, 2)]
    rows = [(i, t, w) for i, t, w in rows if w]
    queries = [(1, "t1", -1.0), (1, "t2", 2.0), (2, "all", 1.0), (3, "nothing", 1.0), (4, "t3", 0.5), (4, "t4", -0.5)]
    index = BlockMaxIndex(spark, str(tmp_path), block=8).add(spark.createDataFrame(rows, ROW))
    assert answers(index.search_batch(spark.createDataFrame(queries, ASKED), k)) == brute(rows, queries, k)


def test_additions_odd_rows_and_empty(spark, tmp_path):
    index = BlockMaxIndex(spark, str(tmp_path / "a"), block=8)
    assert index.search({"t1": 1.0}, 5).count() == 0
    rows = corpus(200, 10, 3)
    index.add(spark.createDataFrame(rows[:400], ROW)).add(spark.createDataFrame([], ROW))
    more = [(i + 1000, t, w) for i, t, w in rows[400:]]
    odd = [(None, "t1", 9.0), (5000, None, 9.0), (5001, "t1", None), (5002, "t1", 0.0), (5003, "t1", 1.0), (5003, "t1", 1.0)]
    index.add(spark.createDataFrame([*more, *odd], ROW).selectExpr("*", "1 as range", "2 as entries"))
    want = brute([*rows[:400], *more, (5003, "t1", 2.0)], [(0, "t1", 1.0), (0, "all", 2.0)], 20)
    found = index.search({"t1": 1.0, "all": 2.0}, 20).collect()
    assert [(r["id"], round(r["score"], 9)) for r in found] == [(i, s) for _, _, i, s in sorted(want, key=lambda x: x[1])]


def test_scan_names_terms_and_zones(spark, tmp_path):
    index = BlockMaxIndex(spark, str(tmp_path), block=4).add(spark.createDataFrame(corpus(100, 10, 4), ROW))
    asked = spark.createDataFrame([(0, "t1", 1.0)], ASKED)
    plan = index._scores(asked, index.bounds(asked).limit(2))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "entries" in line)
    assert "PartitionFilters: [isnotnull(zone" in scan and "(zone" in scan
    assert "EqualTo(term,t1)" in scan and ("In(range" in scan or "EqualTo(range" in scan)


def test_postings_are_not_shuffled_and_ranges_hand_on_their_best(spark, tmp_path):
    rows = [(1, "B a a b b"), (2, None), (3, ""), (4, "x " * 300 + "é"), (5, "A-a"), (5, "c a"), (None, "a")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(2)
    made = vs.sparse_rows(docs)
    one = vs.sparse_rows(docs.filter("id < 5"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" not in one  # nothing is dealt by id or term
    want = sorted((r["id"], r["term"], round(r["weight"], 9)) for r in vs.sparse_encode(docs.filter("id is not null")).collect())
    assert sorted((r["id"], e["term"], round(e["weight"], 9)) for r in made.collect() for e in r["entries"]) == want and len(want) == 6
    held = corpus(500, 20, 6)
    index = BlockMaxIndex(spark, str(tmp_path), block=16).add_rows(spark.createDataFrame(held, ROW).groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("entries")))
    queries = [(q, t, w) for q in range(4) for t, w in ((f"t{q}", 1.0), ("all", 0.2))]
    found = index.search_batch(spark.createDataFrame(queries, ASKED), 10)
    assert answers(found) == brute(held, queries, 10)
    assert not re.search(r"hashpartitioning\(qid#\d+L?, id#", found._jdf.queryExecution().executedPlan().toString())  # sums are not dealt by query and document
