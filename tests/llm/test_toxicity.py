import zlib

from pyspark.sql import functions as F

from recollex.llm import queries as Q
from recollex.llm import toxicity as tx

from .helpers import docs


def test_held_out_documents_are_told_apart(spark):
    # The largest labelled table of the test data at hand; the query learns from four fifths of it.
    found = Q.op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out")
    c = found.agg(F.sum((F.col("predicted") * F.col("toxic"))).alias("hit"), F.sum("predicted").alias("said"), F.sum("toxic").alias("toxic")).first()
    assert c["hit"] / c["said"] >= 0.95 and c["hit"] / c["toxic"] >= 0.8


def test_folds_and_scores(spark, sf_dir):
    found = Q.op4_toxicity(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def labelled(spark, n):
    texts = [("you awful idiot " if i % 3 == 0 else "what a lovely day ") + f"word{i}" for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")
    return docs(spark, texts), labels


def test_learns_and_scores_odd_rows(spark):
    frame, labels = labelled(spark, 200)
    noisy = labels.union(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1), (3, None), (999, 1)], labels.schema))
    model = tx.fit(frame.selectExpr("*", "0 as toxic", "'x' as key"), noisy)
    odd = docs(spark, ["an idiot!!", "AN  IDIOT", "", None, "lovely day " * 5000, "123 ..."]).selectExpr("*", "1 as toxic")
    got = {r["doc_id"]: r["score"] for r in tx.score(odd, model).collect()}
    assert got[0] > 0.5 and abs(got[0] - got[1]) < 1e-12 and got[4] < 0.5 and got[2] == got[3]
    assert tx.score(docs(spark, []), model).count() == 0
    again = tx.fit(frame, labels)
    assert (again.buckets == model.buckets).all()


def test_without_labels_or_classes(spark):
    frame, labels = labelled(spark, 20)
    assert tx.score(frame, tx.fit(frame, labels.limit(0))).filter("abs(score - 0.5) > 1e-9").count() == 0
    one = tx.fit(frame, labels.withColumn("toxic", F.lit(0)))
    assert 0 < tx.score(frame, one).first()["score"] < 0.2


def test_grams_see_whole_texts():
    table = {int(b) for b in tx.grams("idiot")}
    assert table <= {int(b) for b in tx.grams("x " * 50_000 + "idiot")}


def test_query_matches_a_plain_scorer(spark, sf_dir):
    """Counts, ratios, choice of features and descent written plainly: dictionaries, a dense matrix, one text at a time."""
    import re
    from collections import Counter

    import numpy as np

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    train = [k for k in sorted(labels) if k in texts and zlib.crc32(str(k).encode()) % 5]

    def grams(text):
        data = f" {re.sub(r'[^a-zà-öø-ÿœß]+', ' ', text.lower()).strip()} ".encode()
        found = set()
        for n in (4, 6, 8):
            for i in range(len(data) - n + 1):
                h = data[i]
                for c in data[i + 1 : i + n]:
                    h = (h * 0x01000193 + c) % 2**32
                h = (h * 0x9E3779B1 + n) % 2**32
                found.add((h ^ (h >> 15)) % tx.BUCKETS)
        return found

    bags = {k: grams(texts[k]) for k in texts}
    seen = {y: Counter(g for k in train if labels[k] == y for g in bags[k]) for y in (0, 1)}
    size = {y: sum(labels[k] == y for k in train) for y in (0, 1)}
    told = {}
    for g in seen[0] | seen[1]:
        a, b = seen[1][g], seen[0][g]
        if a + b >= tx.LEAST_TEXTS:
            both = (a + b) / (size[0] + size[1])
            told[g] = abs(a / size[1] - b / size[0]) / (both * (1 - both) + 1e-3) ** 0.5
    kept = sorted(told, key=lambda g: (-told[g], g))[: tx.FEATURES]
    at = {g: i for i, g in enumerate(kept)}
    ratio = np.array([np.log((seen[1][g] + 1) / (size[1] + 2)) - np.log((seen[0][g] + 1) / (size[0] + 2)) for g in kept])
    x = np.zeros((len(train), len(kept) + 1))
    for row, k in enumerate(train):
        for g in bags[k] & at.keys():
            x[row, at[g]] = ratio[at[g]]
        x[row, -1] = 1
    y = np.array([labels[k] for k in train], float)
    penalty = np.append(np.full(len(kept), tx.L2), 0)
    v = np.ones(len(kept) + 1)
    for _ in range(12):
        v = x.T @ (x @ v)
        norm = np.linalg.norm(v)
        v /= norm
    w = ahead = np.zeros(len(kept) + 1)
    t = 1.0
    for _ in range(tx.ROUNDS):
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - y) + penalty * ahead
        new, after = ahead - slope / (0.3 * norm + tx.L2), (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
    found = {r["doc_id"]: (r["score"], r["predicted"]) for r in Q.op4_toxicity(spark, sf_dir).collect()}
    assert found.keys() == texts.keys()
    for k in texts:
        score = 1 / (1 + np.exp(-np.clip(sum(w[at[g]] * ratio[at[g]] for g in bags[k] & at.keys()) + w[-1], -30, 30)))
        assert abs(found[k][0] - score) < 1e-6 and (found[k][1] == (score >= 0.5) or abs(score - 0.5) < 1e-6)
