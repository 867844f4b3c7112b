import re

from recollex.llm import decontaminate as dc

from .helpers import docs, rows


def shingles(text, n=5):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts, items, threshold=0.8):
    out = set()
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            s = shingles(x)
            if s and len(s & shingles(t)) >= threshold * len(s):
                out.add((d, i, len(s & shingles(t)), len(s)))
    return out


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


WORDS = [f"w{i}" for i in range(60)]
ITEM = " ".join(WORDS[:30])


def test_short_items_in_long_documents(spark):
    texts = [
        " ".join(["filler"] * 4000 + WORDS[:30] + ["more"] * 4000), " ".join(WORDS[:27]), " ".join(WORDS[:20]), ITEM.upper().replace(" ", "!! "),
        "", None, "w0 w1 w2", "w0 w1", " ".join(WORDS[:15] + ["x"] + WORDS[15:30]), " ".join(WORDS[:15]) + " gap gap " + " ".join(WORDS[11:30]),
    ]
    tests = [ITEM, "w0 w1 w2", "", None, " ".join(WORDS[30:36]), "..."]
    for limit in (400_000, 0):  # with and without the broadcast
        found = rows(dc.contained(docs(spark, texts), items(spark, tests), broadcast_shingles=limit), "doc_id", "item_id", "n_shared", "n_item")
        assert found == sorted(brute(texts, tests), key=repr)
    assert {(0, 0), (1, 0), (3, 0), (6, 1)} <= {r[:2] for r in found} and not any(r[0] == 2 for r in found)


def test_sketches_follow_the_size(spark):
    s = dc.item_shingles(items(spark, [ITEM, " ".join(WORDS[:8])]))
    found = {r["id"]: tuple(r)[1:] for r in dc.sketches(s, picks=10).groupBy("item.id").agg({"shingle": "count", "needed": "max", "class": "max", "least": "max"}).select("id", "count(shingle)", "max(needed)", "max(class)", "max(least)").collect()}
    assert found == {0: (10, dc.enough(10, 0.8), 4, 13), 1: (4, 4, 2, 4)}


def test_enough_bounds_the_chance_of_a_miss():
    import math

    for picks in (1, 8, 32, 64):
        m = dc.enough(picks, 0.8)
        missed = sum(math.comb(picks, i) * 0.8**i * 0.2 ** (picks - i) for i in range(m))
        assert m >= 1 and (missed <= dc.MISS or m == 1)
    assert dc.enough(32, 0.8) > 8


def test_long_items_by_their_sketches(spark):
    import random

    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(5000)]
    tests = [" ".join(r.choices(vocabulary, k=n)) for n in (40, 64, 200, 900)]
    texts = []
    for t in tests:
        w = t.split()
        for share in (1.0, 0.9, 0.82, 0.78, 0.4, 0.1):
            part = w[: int(len(w) * share)]
            texts.append(" ".join(r.choices(vocabulary, k=300) + part + r.choices(vocabulary, k=50)))
    for limit in (400_000, 0):
        found = rows(dc.contained(docs(spark, texts), items(spark, tests), broadcast_shingles=limit, broadcast_pairs=limit), "doc_id", "item_id", "n_shared", "n_item")
        assert found == sorted(brute(texts, tests), key=repr) and len(found) >= 10


def test_rows_that_share_an_id_are_told_apart(spark):
    frame = spark.createDataFrame([(7, ITEM), (7, "clean"), (None, ITEM), (None, "clean too"), (8, " ".join(WORDS[:15])), (8, " ".join(WORDS[15:30]))], "doc_id long, text string")
    assert rows(dc.contained(frame, items(spark, [ITEM, ITEM])), "doc_id", "item_id") == [(7, 0), (7, 1), (None, 0), (None, 1)]
    assert sorted(r["text"] for r in dc.clean(frame, items(spark, [ITEM])).collect()) == sorted(["clean", "clean too", " ".join(WORDS[:15]), " ".join(WORDS[15:30])])


def test_odd_rows(spark):
    frame = docs(spark, [ITEM, ITEM]).selectExpr("*", "1 as item", "2 as shingle", "3 as size")
    nulls = spark.createDataFrame([(None, ITEM)], "item_id long, text string")
    assert rows(dc.contained(frame, nulls), "doc_id", "item_id") == [(0, None), (1, None)]
    assert dc.contained(docs(spark, []), items(spark, [ITEM])).count() == 0
    assert dc.contained(frame, items(spark, [])).count() == 0
    kept = dc.clean(docs(spark, [ITEM, "clean text", None]), items(spark, [ITEM]))
    assert rows(kept, "doc_id") == [(1,), (2,)] and kept.columns == docs(spark, []).columns


def test_plan_is_native_and_scans_two_columns(spark, sf_dir):
    text = dc.contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", text)
