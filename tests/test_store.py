"""Kept indexes, stores, signatures, replicas, media, commands: odd cases and brute force."""

import io
import json
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.adapters import Memory, Retriever, VectorStore
from recollex.functions import scores, signing
from recollex.operators import fulltext as ft, graph, oplog, ordering, plugins as pg, shards as sh, vectorindex as vi
from recollex.operators.store import MOST_CHARS, call_tool, open_store
from recollex.operators.textindex import TextIndex
from recollex.sources import container, media
from recollex.storage import new_path

DOC = "id long, title string, text string"


def texts(spark, rows):
    return spark.createDataFrame([(i, None, t) for i, t in rows], DOC)


def hits(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


def test_text_index_follows_a_fresh_search(spark):
    rows = {i: f"{'alpha ' * (i % 4)}{'beta ' * (i % 3)}word{i}" for i in range(40)}
    index = TextIndex(spark, new_path(spark, "t"), part=40)
    assert index.search("alpha", 5).count() == 0
    index.merge(texts(spark, rows.items()))
    for change, gone in (({3: "alpha only", 50: "beta beta"}, []), ({}, [1, 2, 50]), ({2: "", 60: None}, [60])):
        rows |= change
        for i in gone:
            rows.pop(i, None)
        index.merge(texts(spark, change.items()) if change else None, spark.createDataFrame([(i,) for i in gone], "id long") if gone else None)
        for query in ("alpha OR beta", "alpha beta", "nothing"):
            assert hits(index.search(query, 50)) == hits(ft.search(texts(spark, rows.items()), query, 50))
    before = hits(index.search("alpha OR beta", 50))
    assert hits(index.compact().search("alpha OR beta", 50)) == before and len(index.generations()) == 1


def test_text_index_reads_the_parts_of_its_terms_alone(spark):
    index = TextIndex(spark, new_path(spark, "t"), part=50).build(texts(spark, [(i, f"w{i} w{i + 1} common") for i in range(200)]))
    parts = index.terms("common").first()["parts"]
    assert len(parts) > 1  # a common term fills several parts
    scan = next(x for x in index.postings(["w5"])._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(part" in scan and "EqualTo(term,w5)" in scan and "ReadSchema: struct<term:string,id:bigint" in scan
    assert index.postings(["w5"]).count() == 2 and len(index.terms("w5").first()["parts"]) == 1
    # A search's plan has postings, dictionary and sizes, and no text.
    plan = index.search("common w5", 5)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "title" not in plan


def test_text_index_merges_without_old_postings(spark, monkeypatch):
    index = TextIndex(spark, new_path(spark, "t"), part=50).build(texts(spark, [(i, f"w{i} common") for i in range(60)]))
    read, plain = [], TextIndex._all
    monkeypatch.setattr(TextIndex, "_all", lambda self, what, schema: read.append(what) or plain(self, what, schema))
    index.merge(texts(spark, [(3, "other words"), (100, "common")]), spark.createDataFrame([(5,)], "id long"))
    assert set(read) == {"docs"}
    monkeypatch.undo()
    assert index.stats().first()["n"] == 60 and index.sizes().count() == 60
    assert {r["id"] for r in index.postings(["common"]).collect()} == ({*range(60)} - {3, 5}) | {100}


LINES = ["the red fox", "red the fox the red", "Fox! Red fox; red-fox", "", None, "foxes reddish", "a a a b a a b", "\U00010400x the", "red" * 3]


def test_phrases_prefixes_and_alternatives_come_from_the_index(spark):
    rows = [(i, "the red" if i % 2 else None, t) for i, t in enumerate(LINES)]
    index = TextIndex(spark, new_path(spark, "t"), part=6).build(spark.createDataFrame(rows, DOC))

    def cut(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    def phrase(words):
        out = {}
        for i, title, text in rows:
            n = sum(f[j : j + len(words)] == words for f in (cut(title), cut(text)) for j in range(len(f)))
            if n:
                out[i] = n
        return out

    for words in (["red", "fox"], ["the", "red"], ["a", "a"], ["a", "a", "b"], ["fox"], ["red", "the", "fox", "the"], ["none", "fox"]):
        assert {r["id"]: r["times"] for r in index.phrase(words).collect()} == phrase(words)
    assert index.phrase([]).count() == 0
    for start in ("re", "fox", "red", "zz", "\U00010428"):
        want = {i: n for i, title, text in rows if (n := sum(w.startswith(start) for w in cut(title) + cut(text)))}
        assert {r["id"]: r["tf"] for r in index.prefix(start).collect()} == want
    both = index.any_of(words=("b",), phrases=(("red", "fox"),), prefixes=("reddi", "b"))
    assert {r["id"]: r["parts"] for r in both.collect()} == {0: 1, 2: 1, 5: 1, 6: 2}
    index.merge(spark.createDataFrame([(0, None, "blue fox")], DOC))
    assert {r["id"] for r in index.phrase(["red", "fox"]).collect()} == {2} and {r["id"] for r in index.phrase(["blue", "fox"]).collect()} == {0}
    assert {r["id"] for r in index.compact().phrase(["blue", "fox"]).collect()} == {0}


def test_search_within_takes_the_statistics_of_what_is_left(spark):
    rows = [(i, f"{'alpha ' * (i % 4)}beta word{i}") for i in range(30)]
    index = TextIndex(spark, new_path(spark, "t")).build(texts(spark, rows))
    part = texts(spark, [r for r in rows if r[0] % 3])
    assert hits(index.search("alpha OR beta", 10, within=part.select("id"))) == hits(ft.search(part, "alpha OR beta", 10))


def test_positions_without_a_global_window(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("c")).repartition(7)
    found = ordering.with_positions(rows, "k", total="c").orderBy("k").collect()
    assert [r["position"] for r in found] == list(range(1, 1001))
    assert [r["used"] for r in found] == np.cumsum([r["c"] for r in found]).tolist()
    assert ordering.with_positions(rows.limit(0), "k", total="c").count() == 0
    plan = ordering.with_positions(rows, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_replacements_of_any_length_and_circles(spark):
    steps = {i: i + 1 for i in range(300)} | {1000: 1001, 1001: 1002, 1002: 1000, 1003: 1001, 2000: 2000, 1004: 1003}

    def plain(x):
        path = [x]
        while path[-1] in steps and steps[path[-1]] not in path:
            path.append(steps[path[-1]])
        return path[-1]

    found = graph.supersession(spark.createDataFrame(list(steps.items()), "from_id long, to_id long")).collect()
    assert {r["id"]: r["current"] for r in found} == {x: plain(x) for x in steps}
    assert graph.supersession(spark.createDataFrame([], "from_id long, to_id long")).count() == 0


def test_walks_visit_a_place_once_however_many_paths_lead_there(spark):
    layers = [(f"n{i}{a}", f"n{i + 1}{b}", "caused") for i in range(14) for a in "xyz" for b in "xyz"]
    edges = spark.createDataFrame(layers, "from_uri string, to_uri string, rel string")
    assert graph.expand(edges, "n0x", 20).count() == 1 + 14 * 3
    assert graph.why(edges, "n14x", 3).count() == 1 + 2 * 3 and graph.why(edges, "nowhere", 3).count() == 0 and graph.why(edges, "n14x", 0).count() == 0


def test_signatures_of_the_published_vectors():
    key = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert signing.public_key(key).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert signing.sign(key, b"").hex() == "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    key = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    signature = signing.sign(key, b"\x72")
    assert signature.hex().startswith("92a009a9f0d4cab8720e820b5f642540") and signing.verify(signing.public_key(key), b"\x72", signature)
    assert not signing.verify(signing.public_key(key), b"\x73", signature) and not signing.verify(signing.public_key(key), b"\x72", None) and not signing.verify(b"x", b"", signature)


def test_halves_and_bytes(spark):
    values = [0.0, -0.0, 1.0, -2.5, 65504.0, 65520.0, -1e9, 6e-8, 1e-9, 3.14159265, 0.1, 2049.0, 2051.0, -5.96e-8]
    row = spark.createDataFrame([(values,)], "v array<double>").select(scores.half(F.col("v")).alias("h"), scores.unpack_floats(scores.pack_floats(F.col("v"))).alias("b")).first()
    with np.errstate(over="ignore"):
        assert [float(x) for x in np.array(values, np.float16)] == row["h"]
    assert row["b"] == [float(np.float32(x)) for x in values]
    assert spark.createDataFrame([(bytes(5),)], "v binary").select(scores.unpack_floats(F.col("v"))).first()[0] is None


def test_replicas_end_alike_whatever_each_lacks(spark):
    ops = [(f"a{i % 3}", i // 3 + 1, "delete" if i % 10 == 0 else "put", i % 17, (i * 31) % 50, f"p{i}") for i in range(90)]
    schema = "actor string, seq long, kind string, doc_id long, ts long, payload string"
    whole = spark.createDataFrame(ops, schema)
    a, b = whole.filter("seq % 4 <> 0 or actor = 'a0'"), whole.filter("seq % 3 <> 1 or actor <> 'a1'")
    x, y = oplog.exchange(a, b)
    want = sorted(map(tuple, a.union(b).distinct().collect()))
    assert len(want) == 87
    assert sorted(map(tuple, x.select(*whole.columns).collect())) == want == sorted(map(tuple, y.select(*whole.columns).collect()))
    assert sorted(map(tuple, oplog.decode(oplog.encode(whole, batch=7)).select(*whole.columns).collect())) == sorted(ops)
    assert {r["actor"]: r["known"] for r in oplog.state_vector(a).collect()} == {"a0": 30, "a1": 3, "a2": 3}


def test_bloom_filters_pass_all_members_and_few_strangers(spark):
    members = spark.range(20000).select((F.col("id") % 4).alias("shard"), F.concat(F.lit("t"), "id").alias("token"))
    filters = sh.bloom(members).cache()
    passed = sh.may_hold(filters, members.select("token")).join(members, ["shard", "token"], "left_semi").count()
    strangers = spark.range(5000).select(F.concat(F.lit("x"), "id").alias("token"))
    assert passed == 20000 and sh.may_hold(filters, strangers).count() / 20000 < 0.02


def test_cells_forget_and_replace(spark):
    x = np.random.default_rng(1).standard_normal((300, 8)).astype(np.float32)
    frame = lambda ids, scale=1: spark.createDataFrame([(int(i), [float(a) for a in x[i] * scale]) for i in ids], "id long, embedding array<float>")
    index = vi.CellIndex(spark, new_path(spark, "cells")).build(frame(range(300)), 6)
    index.remove(frame([0, 1, 2]).select("id"))
    index.insert(frame([1, 5], -1))
    assert index.size() == 298
    q = [float(a) for a in x[5]]
    near = [r["id"] for r in index.search(q, 3, probes=6).collect()]
    assert 5 not in near and index.search(q, 300, probes=6).count() == 298
    index.rebuild(4)
    assert index.size() == 298 and [r["id"] for r in index.search(q, 3, probes=4).collect()] == near
    with pytest.raises(ValueError):
        vi.CellIndex(spark, "x", storage="f8")


def test_store_refuses_repeats_and_answers_every_request(spark):
    store = open_store(spark)
    assert store.stats() == {"docs": 0, "vectors": 0} and store.search("lex", "x", 3) == []
    rows = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three"), (None, "lost"), (4, None)], "id long, text string")
    assert sorted(r["id"] for r in store.put(rows).collect()) == [1, 3] and store.put(rows).count() == 0
    with pytest.raises(ValueError):
        store.put(spark.createDataFrame([(9, "x" * (MOST_CHARS + 1))], "id long, text string"))
    assert store.delete(spark.createDataFrame([(1,), (77,)], "id long")) == 1 and store.stats() == {"docs": 1, "vectors": 1}
    assert "error" in store.handle({}) and "error" in store.handle({"kind": "sql", "sql": "nonsense"}) and store.handle({"kind": "get", "ids": [3]})["ok"][0]["text"] == "three"
    with pytest.raises(ValueError):
        call_tool("nothing")
    with pytest.raises(ValueError):
        store.attach("no name", "x")


def test_adapters(spark):
    store = open_store(spark)
    memory = Memory(store)
    assert memory.add(["likes green tea", "lives by the sea"], "ann") == [1, 2] and memory.add(["likes tea too"], "bob") == [3]
    assert [m["id"] for m in memory.search("tea", "ann")] == [1] and [m["memory"] for m in memory.get_all("bob")] == ["likes tea too"]
    assert memory.delete([1]) == 1 and [m["id"] for m in memory.get_all("ann")] == [2]
    assert [r["metadata"]["id"] for r in Retriever(store).invoke("tea OR sea")] in ([2, 3], [3, 2])
    assert VectorStore(store).add([9], ["a vector"], [[1.0] + [0.0] * 63]) == 1 and VectorStore(store).query([1.0] + [0.0] * 63, 1)[0][0] == 9


def test_containers_are_whole_or_refused(spark):
    path = new_path(spark, "c")
    writer = container.Writer(spark, path).add("docs", spark.range(5))
    with pytest.raises(ValueError):
        container.Reader(spark, path)
    writer.close()
    assert container.Reader(spark, path).verify() == []
    spark.range(1).write.mode("append").parquet(f"{path}/chunk=docs")
    assert container.Reader(spark, path).verify() == ["docs"]
    with pytest.raises(ValueError):
        container.unpack(spark, path)
    with pytest.raises(ValueError):
        container.Writer(spark, new_path(spark, "c")).add("junk", spark.range(1))


def png(rows, kind=0):
    step = {0: 1, 2: 3}[kind]
    lines = b"".join(bytes([y % 5]) + _filtered(rows, y, y % 5, step) for y in range(len(rows)))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", len(rows[0]) // step, len(rows), 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _filtered(rows, y, how, step):
    out = []
    for x, v in enumerate(rows[y]):
        a = rows[y][x - step] if x >= step else 0
        b = rows[y - 1][x] if y else 0
        c = rows[y - 1][x - step] if y and x >= step else 0
        p = a + b - c
        near = (abs(p - a), abs(p - b), abs(p - c))
        guess = [0, a, b, (a + b) // 2, a if near[0] <= near[1] and near[0] <= near[2] else b if near[1] <= near[2] else c][how]
        out.append((v - guess) % 256)
    return bytes(out)


def test_images_are_read_alike_in_all_forms(spark, tmp_path):
    rows = np.random.default_rng(2).integers(0, 256, (9, 12)).tolist()
    pgm = b"P5\n# note\n12 9\n255\n" + bytes(v for r in rows for v in r)
    assert media.gray_pixels(pgm).tolist() == rows == media.gray_pixels(png(rows)).tolist()
    colour = [[v for p in r for v in (p, p, p)] for r in rows]
    assert media.gray_pixels(png(colour, 2)).tolist() == rows
    v = media.image_vector(pgm, 32)
    assert abs(sum(v[:16]) - 1) < 1e-12 and v[:16] == v[16:]
    with pytest.raises(ValueError):
        media.gray_pixels(b"GIF89a")
    (tmp_path / "clip").mkdir()
    for i in range(3):
        (tmp_path / "clip" / f"{i}.pgm").write_bytes(pgm)
    (tmp_path / "still.png").write_bytes(png(rows))
    assert media.image_vectors(spark, str(tmp_path)).count() == 4
    clip = media.clip_vectors(spark, f"{tmp_path}/clip").first()
    assert clip["n"] == 3 and np.allclose(clip["embedding"], media.frames_vector([pgm])) and abs(np.linalg.norm(clip["embedding"]) - 1) < 1e-9


def test_draws_have_the_moments_of_their_laws():
    rng = np.random.default_rng(0)
    for shape in (0.3, 1.0, 4.5):
        draws = np.array([pg.gamma_draw(rng, shape) for _ in range(20000)])
        assert abs(draws.mean() - shape) < 0.05 * max(shape, 1) and abs(draws.var() - shape) < 0.15 * max(shape, 1)
    assert pg.gamma_draw(rng, 0) is None and pg.beta_draw(rng, 1, -1) is None


def test_unknown_rerankers_are_refused(spark):
    with pytest.raises(ValueError):
        pg.reranker("nothing")
    rows = spark.createDataFrame([(1, 0.5, "a b", 1), (2, 0.9, "c", 2)], "id long, score double, text string, rank int")
    assert [r["id"] for r in pg.reranker(None).rerank("a", rows, 5).collect()] == [2, 1]
    assert [r["id"] for r in pg.reranker("cascade").rerank("abc def", rows, 1).collect()] == [1]


def test_commands(spark, tmp_path, capsys):
    from recollex.__main__ import main

    (tmp_path / "in.jsonl").write_text('{"text": "green tea"}\n{"text": "blue sea"}\n{"text": "green tea"}\n')
    run = lambda *a: (main(["--store", f"{tmp_path}/s", *a]), json.loads(io.StringIO(capsys.readouterr().out).read().strip().splitlines()[-1]))[1]
    assert run("import", f"{tmp_path}/in.jsonl") == {"added": 2} and run("stats") == {"docs": 2, "vectors": 2}
    assert len(run("search", "green")) == 1 and run("verify") == [] and run("sql", "select count(*) as n from docs") == [{"n": 2}]
    assert run("export", f"{tmp_path}/out.parquet") == {"written": 2} and spark.read.parquet(f"{tmp_path}/out.parquet").count() == 2
