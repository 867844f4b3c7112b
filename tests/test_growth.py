"""Steps whose work must follow the input: what they shuffle, hold and hand to Python."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recollex.functions import scores, text as tx
from recollex.operators import agent as ag, forest as fr, gazetteer as gz, graph as g, memory as mm, plugins as pg, vectors as vs
from recollex.operators.textindex import TextIndex
from recollex.plans import search_queries as sq
from recollex.sources import files
from recollex.storage import new_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_placed_without_a_shuffle(spark):
    rows = [(1, "B a", "a b, a"), (2, None, ""), (3, "", "x " * 300 + "a"), (4, "ß", None), (5, None, "A-a")]
    cut = TextIndex(spark, new_path(spark, "growth"))._cut(spark.createDataFrame(rows, "id long, title string, text string").repartition(2))
    assert "hashpartitioning(term" not in plan(cut) and "hashpartitioning(w" not in plan(cut) and "collect_list" not in plan(cut)
    got = {(r["id"], r["term"]): (r["tf"], r["dl"], r["positions"]) for r in cut.collect()}
    assert got == {
        (1, "b"): (2, 5, [0, 4]), (1, "a"): (3, 5, [1, 3, 5]), (3, "x"): (300, 301, list(range(1, 301))), (3, "a"): (1, 301, [301]),
        (4, "ß"): (1, 1, [0]), (5, "a"): (2, 2, [1, 2]),
    }


def test_bytes_of_floats(spark):
    rows = [(1, [1.0, -2.5]), (2, None), (3, []), (4, [0.1, None])]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1).withColumn("b", scores.pack_floats(F.col("v")))
    got = {r["id"]: r["b"] and bytes(r["b"]) for r in df.collect()}
    assert got[1] == np.array([1, -2.5], "<f4").tobytes() and got[2] is None and len(got[4]) == 8
    back = df.withColumn("b", F.when(F.col("id") == 3, F.lit(b"abc")).otherwise(F.col("b"))).select("id", scores.unpack_floats(F.col("b")).alias("v"))
    held = {r["id"]: r["v"] for r in back.collect()}
    assert held[1] == [1.0, -2.5] and held[2] is None and held[3] is None and held[4][0] == np.float32(0.1)


def test_token_vectors_are_stored_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "c " * 3000)], "id long, text string").repartition(2)
    made = pg.stored_token_vectors(docs, dim=8)
    assert "hashpartitioning" not in plan(made)
    rows = lambda df: sorted((r["id"], r["token"], tuple(r["embedding"])) for r in df.collect())
    assert rows(pg.load_token_vectors(made)) == rows(pg.token_vectors(docs, dim=8)) and len(rows(pg.token_vectors(docs, dim=8))) == 3003


def test_all_near_pairs_are_found(spark, monkeypatch):
    monkeypatch.setattr(fr, "BLOCK", 100)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((150, 64)), 4, axis=0) + 0.15 * rng.standard_normal((600, 64))
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T, 1) > 0.95), strict=True)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0, 2.0]), (901, [1.0, 2.1])], "id long, embedding array<double>")
    pairs, _ = fr.near_pairs(df, 0.95, exact=True)
    assert {(r["keep"], r["drop"]) for r in pairs.collect()} == want | {(900, 901)} and len(want) > 500


def test_planted_copies_alone_beside_other_near_vectors(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal(64)
    rows = [(i, (x + 0.001 * i).tolist()) for i in range(7)] + [(10, x.tolist())]  # near each other, and a copy
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["keep"], r["drop"]) for r in sq.QUERIES["jn17_vs26_forest"](spark, str(tmp_path)).collect())
    assert got == sorted([(i, i + 10**9) for i in (0, 3, 6)] + [(i, i + 2 * 10**9) for i in (0, 5, 10)])


def test_sqlite_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE_CHARS", 1000)
    docs = spark.range(50).selectExpr("id", "'t' as title", "concat('u/', id) as uri", "repeat('x', 200) as text", "'{}' as meta").coalesce(1)
    named = files.write_sqlite(docs, f"file://{tmp_path}/db").collect()
    assert len(named) >= 10 and sum(r["n"] for r in named) == 50
    assert files.read_documents(spark, f"file://{tmp_path}/db", "sqlite").select("uri").distinct().count() == 50


def test_places_of_spans(spark):
    docs = spark.createDataFrame([(1, "Ab ä cd"), (2, None), (3, "")], "id long, text string").coalesce(1)
    got = {r["id"]: [tuple(s) for s in r["s"]] for r in docs.select("id", gz.spans(r"\w+", lower=True).alias("s")).collect()}
    assert got == {1: [(0, 2, "ab"), (3, 4, "ä"), (5, 7, "cd")], 2: [], 3: []}


def test_evolution_compares_without_pairs_of_texts(spark):
    rows = [(1, "aaa bbb ccc"), (2, "aaa bbb ccc"), (3, "aaa bbb ddd"), (4, ""), (5, None), (6, "zzz " * 500)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(2)
    got = mm.evolve(docs, docs, 0.5, 1.1, window=4)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert sorted((r["id"], r["replaces"]) for r in got.collect()) == [(1, 3), (2, 3)]
    assert sorted((r["id"], r["replaces"]) for r in mm.evolve(docs, docs, 0.5, 1.1).collect()) == [(1, 2), (2, 1), (3, 1)]
    assert mm.evolve(docs, docs.limit(0), 0.5, 1.1).count() == 0


def test_chance_meetings_of_sets_are_dropped_before_lists_are_fetched(spark):
    common = " ".join(f"common{i}" for i in range(60))
    texts = [f"{common} " + " ".join(f"rare{min(i, j)}x{max(i, j)}" for j in range(40) if j != i) for i in range(40)]  # each two share one rare word
    texts.append(texts[0].replace("rare0x1 ", "").replace("rare0x2 ", ""))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    ordered = mm.materialize(rows.select("id", F.array_sort(F.transform(F.split("text", " "), lambda w: F.when(F.startswith(w, F.lit("rare")), F.lit(0)).otherwise(F.lit(1 << 40)) + F.pmod(F.xxhash64(w), F.lit(1 << 39)))).alias("t")), "sets")
    assert [(r["a"], r["b"]) for r in mm._met(ordered, 0.8).collect()] == [(40, 0)]
    assert [(r["a"], r["b"]) for r in mm.similar_pairs(rows.union(rows.filter("id < 3")), 0.8).collect()] == [(0, 40)]


def test_retrieval_by_entities_asks_for_the_edges_of_live_entities_alone(spark):
    texts = ["Anna met Bert. Then Carl.", "Anna and Carl, Carl", "Bert saw Dora", "Emil or Fritz", None, "", "Emil by Gustav Adolf"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "Dora by Hans")], "id long, text string").repartition(3)
    mentions = docs.select("id", F.explode(tx.entities(F.col("text"))).alias("entity"))
    held = g.entity_rows(mentions)
    asked = []

    def edges(front):
        asked.append({r["id"] for r in front.collect()})
        return g.edges_of(held, front)

    rows = lambda df: [(r["id"], round(r["score"], 9)) for r in df.collect()]
    whole = rows(ag.hippo_retrieve(mentions, g.entity_graph(docs), "Anna", 10, rounds=3))
    assert rows(ag.hippo_retrieve(mentions, edges, "Anna", 10, rounds=3)) == whole and len(whole) == 3
    number = {r["e"]: r["h"] for r in mentions.select(F.col("entity").alias("e"), F.xxhash64("entity").alias("h")).collect()}
    assert asked[0] == {number["Anna"]} and number["Emil"] not in set().union(*asked) and sum(map(len, asked)) == len(set().union(*asked))


def test_retrieval_by_entities_walks_to_all_partners(spark):
    names = [chr(65 + i % 26) + chr(97 + i // 26) + "x" for i in range(150)]
    texts = [" and ".join(["Anna", *names]), "Anna or Bert", "Bert, Carl", *[f"{n} by Bert" for n in names[::7]], "Emil or Fritz", "Lone", None, *[f"Anna{chr(97 + i)} 1 Gus{chr(97 + i)}" for i in range(15)]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "Carl or Dora")], "id long, text string").repartition(3)
    mentions = docs.select("id", F.explode(tx.entities(F.col("text"))).alias("entity"))
    of = {}
    for r in mentions.collect():
        of.setdefault(r["id"], set()).add(r["entity"])
    weight, rank = {}, {}
    for found in of.values():
        for a in found:
            for b in found - {a}:
                weight.setdefault(a, {}).setdefault(b, 0)
                weight[a][b] += len(found) ** -0.5
    seeds = [e for e in set().union(*of.values()) if "anna" in e.lower()]
    rank = home = {e: 1 / len(seeds) for e in seeds}
    for _ in range(3):
        after = {e: 0.15 * x for e, x in home.items()}
        for e, x in rank.items():
            for to, w in weight[e].items():
                after[to] = after.get(to, 0) + 0.85 * x * w / sum(weight[e].values())
        rank = after
    assert len(seeds) == 16 and len(weight["Anna"]) > 64
    want = {i: round(max(rank[e] for e in found if e in rank), 9) for i, found in of.items() if found & set(rank)}
    for edges in (None, g.entity_graph(docs)):
        assert {r["id"]: round(r["score"], 9) for r in ag.hippo_retrieve(mentions, edges, "Anna", 1000, rounds=3).collect()} == want


def test_entity_pairs_are_summed_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(g, "PAIRS", 7)
    names = [chr(65 + i % 26) + "abcdefgh"[i // 26] + "x" for i in range(60)]
    rng = np.random.default_rng(5)
    texts = [" and ".join(["The", *rng.choice(names, rng.integers(0, 9), replace=True)]) for _ in range(80)] + [None, "", "Lone", "Ab"]
    rows = list(enumerate(texts)) + [(3, texts[4]), (3, texts[3]), (None, "Null and Nil")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    of, want = {}, {}
    for i, text in rows:
        if i is not None:
            of.setdefault(i, set()).update(w for w in (text or "").split(" and ") if len(w) > 2)
    for found in of.values():
        for a in found:
            for b in found - {a}:
                want[a, b] = want.get((a, b), 0) + len(found) ** -0.5
    made = g.entity_graph(docs)
    assert "hashpartitioning(from_entity" not in plan(made) and "hashpartitioning(entity" not in plan(made)
    got = [(r["from_entity"], r["to_entity"], round(r["weight"], 9)) for r in made.collect()]
    assert sorted(got) == sorted((a, b, round(w, 9)) for (a, b), w in want.items()) and len(got) > 500
    assert g.entity_graph(docs.limit(0)).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
@pytest.mark.parametrize("most", [10**6, 50])
def test_a_task_hands_on_the_nearest_of_all_its_tiles(monkeypatch, metric, most):
    monkeypatch.setattr(vs, "HELD_HITS", most)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((90, 8)).round(2)
    x[1::3], x[5], x[40:60:3] = x[1], 0, x[41] + 1e-8  # copies, a null vector, and what 32 bits can't tell apart
    ids = np.arange(90)
    pack = lambda a, b: {"ids": ids[a:b].astype(np.int64).tobytes(), "matrix": x[a:b].tobytes()}
    asked = [{"qids": pack(a, b)["ids"], "queries": pack(a, b)["matrix"]} for a, b in ((0, 50), (50, 90))]
    tiles = [q | pack(a, a + 18) for a in (72, 0, 36, 18, 54) for q in asked]
    made = pd.concat(vs._nearest_in_tiles(8, 7, metric)(pd.DataFrame([t]) for t in tiles))
    d = np.round(vs._distances(x, x, metric), 9)
    d = d if metric != "l2" else np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 9)
    if most > 1000:
        assert len(made) == 90 * 7  # and not that for each of five tiles
    got = {q: sorted(zip(rows["distance"], rows["id"], strict=True))[:7] for q, rows in made.groupby("qid")}
    for q in range(90):
        want = sorted(zip(d[q], ids, strict=True))[:7]
        assert np.allclose([r[0] for r in got[q]], [w[0] for w in want], atol=1e-6)
        if metric == "cosine":
            assert all(r[1] == w[1] or abs(r[0] - w[0]) <= 1.1e-9 for r, w in zip(got[q], want, strict=True))
