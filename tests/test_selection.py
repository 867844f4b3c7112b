"""Exact order statistics, names of a gazetteer, and SQL functions over a graph, against plain code."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from recollex.operators import agent, gazetteer as gz, selection as sl


def ranks(spark, rows, most):
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    n = F.col("n")
    wanted = {"low": F.lit(0), "mid": F.floor(n / 2), "p95": F.floor(n * 0.95), "high": n - 1, "none": n}
    return {r["g"]: tuple(r)[1:] for r in sl.select_ranks(frame, ["g"], "x", wanted, most=most).collect()}


def plain(rows):
    out = {}
    for g in {g for g, _ in rows}:
        x = sorted(v for h, v in rows if h == g and v is not None and not math.isnan(v))
        if x:
            n = len(x)
            out[g] = (n, x[0], x[n // 2], x[math.floor(n * 0.95)], x[-1], None)
    return out


@pytest.mark.parametrize("most", [1, 20, 100_000])
def test_ranks_are_exact_whatever_the_brackets(spark, most):
    rng = random.Random(3)
    rows = [("even", rng.random()) for _ in range(3000)] + [("tied", float(rng.choice([1, 1, 1, 1, 2, 3]))) for _ in range(2000)]
    rows += [("one", 5.0), (None, 1.0), (None, 2.0), ("odd", None), ("odd", float("nan")), ("odd", float("inf")), ("odd", -1.0), ("blank", None)]
    rows += [("mostly", 0.0)] * 1900 + [("mostly", float(i)) for i in range(-50, 50)]
    assert ranks(spark, rows, most) == plain(rows)


def test_no_group_is_sorted_as_a_whole(spark):
    frame = spark.range(10_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 10_007).cast("double").alias("x"))
    found = sl.select_ranks(frame, ["g"], "x", {"p": F.floor(F.col("n") / 2)}, most=100)
    assert found.first()["p"] == sorted(i * 7919 % 10_007 for i in range(10_000))[5000]
    assert sl.select_ranks(frame.limit(0), ["g"], "x", {"p": F.lit(0)}).count() == 0


def test_without_groups(spark):
    frame = spark.createDataFrame([(3,), (1,), (2,), (None,)], "x int")
    assert tuple(sl.select_ranks(frame, [], "x", {"a": F.lit(1)}).first()) == (3, 2)


# --- names


def plain_names(text, names):
    """Leftmost-longest, without case, on whole words."""
    found = []
    for m in re.finditer(r"\w+", text):
        best = None
        for name in names:
            end = m.start() + len(name)
            if text[m.start() : end].lower() == name.lower() and not re.match(r"\w", text[end : end + 1]):
                best = max(best or end, end)
        if best is not None and (not found or m.start() >= found[-1][1]):
            found.append((m.start(), best))
    return found


NAMES = ["new york", "New York City", "york", "city hall", "Ann", "ann b. lee", "x", "Q-7", "hall of fame", "élan vital"]
TEXTS = ["In New York City Hall of Fame new york.", "york yorks newyork NEW  YORK", "Ann B. Lee and ann b lee, ANN", "x x xx x-x q-7 Q 7", "", None, "Élan Vital élan", "city hall of fame " * 200]


def test_names_are_leftmost_longest(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    names = spark.createDataFrame([(n, "k") for n in [*NAMES, None, "", "--"]], "name string, kind string")
    found = {(r["id"], r["start"], r["end"], r["text"]) for r in gz.find(docs, names).collect()}
    want = {(i, a, b, t[a:b]) for i, t in enumerate(TEXTS) if t for a, b in plain_names(t, NAMES)}
    assert found == want
    assert gz.find(docs, names.limit(0)).count() == 0 and gz.find(docs.limit(0), names).count() == 0


def test_many_names_need_no_pattern_of_all(spark):
    names = spark.range(200_000).select(F.concat(F.lit("name "), F.col("id").cast("string"), F.lit(" end")).alias("name"), F.lit("k").alias("kind"))
    docs = spark.createDataFrame([(1, "a name 77 end name 199999 end name 200000 end name 5"), (2, "nothing")], "id long, text string")
    assert {(r["id"], r["text"]) for r in gz.find(docs, names).collect()} == {(1, "name 77 end"), (1, "name 199999 end")}


def test_spans_inside_longer_ones_drop_out(spark):
    docs = spark.createDataFrame([(1, "Ada Byron wrote to ada@byron.org on 1843-07-10, see https://byron.org/1843-07-10")], "id long, text string")
    found = {(r["kind"], r["text"]) for r in agent.tiered_entities(docs, {"ada": "name", "byron": "name"}).collect()}
    assert found == {("pair", "Ada Byron"), ("email", "ada@byron.org"), ("date", "1843-07-10"), ("url", "https://byron.org/1843-07-10")}


# --- SQL functions


def test_graph_functions_take_arguments_and_stay_apart(spark):
    schema = "from_id long, to_id long, rel string, weight double"
    one = spark.createDataFrame([(1, 2, "r", 0.5), (2, 3, "r", 0.9), (3, 1, "r", 0.2), (1, 3, "s", 0.7)], schema)
    agent.register_graph_functions(spark, one, "one")
    agent.register_graph_functions(spark, one.filter("rel = 's'"), "two")
    assert {r["to_id"] for r in spark.sql("SELECT * FROM one_out(1)").collect()} == {2, 3}
    assert {r["to_id"] for r in spark.sql("SELECT * FROM two_out(1)").collect()} == {3}
    assert {r["from_id"] for r in spark.sql("SELECT * FROM one_in(3)").collect()} == {1, 2}
    assert {(r["from_id"], r["to_id"]) for r in spark.sql("SELECT * FROM one_between(3, 0.5)").collect()} == {(2, 3), (1, 3)}
    assert {(r["id"], r["depth"]) for r in spark.sql("SELECT * FROM one_hops(1, 5)").collect()} == {(1, 0), (2, 1), (3, 1)}
    rows = spark.sql("SELECT n.id, o.to_id FROM VALUES (2L), (9L) n(id), LATERAL one_out(n.id) o").collect()
    assert {(r["id"], r["to_id"]) for r in rows} == {(2, 3)}
    with pytest.raises(ValueError):
        agent.register_graph_functions(spark, one, "x; drop")
