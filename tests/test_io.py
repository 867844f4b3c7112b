"""Files, snapshots, projects, sound, streams."""

import json
import math
import sqlite3
import struct
import wave

import pytest
from pyspark.sql import functions as F

from recollex.sources import files, media, projects, snapshots
from recollex.streaming import streams as st

DOC = "id long, title string, uri string, text string, meta string, ts long"
ROWS = [(1, "t", "u/1", 'say "hi",\nnext', '{"a":1}', 5), (2, None, None, "plain", None, 6)]


@pytest.mark.parametrize("fmt", ["csv", "tsv", "jsonl", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    path = f"{tmp_path}/out.{fmt}"
    files.write_documents(spark.createDataFrame(ROWS, DOC), path)
    back = sorted(tuple(r) for r in files.read_documents(spark, path).select("text", "title", "uri", "meta").collect())
    assert [b[:3] for b in back] == [("plain", None, None), ('say "hi",\nnext', "t", "u/1")]
    if fmt in ("jsonl", "parquet"):
        assert json.loads(back[1][3]) == {"a": 1}


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TEXT,Title\nhello,\n,empty\nworld,x,extra\n")
    assert sorted(r["text"] for r in files.read_documents(spark, f"{tmp_path}/a.csv").collect()) == ["hello", "world"]
    (tmp_path / "one.json").write_text('{"text": "single", "meta": {"k": "v"}}')
    assert files.read_documents(spark, f"{tmp_path}/one.json").first()["meta"] == '{"k":"v"}'
    (tmp_path / "bad.jsonl").write_text('{"text": "a"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        files.read_documents(spark, f"{tmp_path}/bad.jsonl").collect()
    (tmp_path / "no.csv").write_text("x\n1\n")
    with pytest.raises(ValueError, match="text"):
        files.read_documents(spark, f"{tmp_path}/no.csv")
    with pytest.raises(ValueError, match="Parquet"):
        files.detect("x.lance")
    assert files.detect("x.bin", "csv") == "csv"


def test_sqlite(spark, tmp_path):
    path = tmp_path / "other.db"
    db = sqlite3.connect(path)
    db.execute("create table docs (id integer primary key, text text, title text)")
    db.executemany("insert into docs values (?, ?, ?)", [(i, f"t{i}", None) for i in range(25)])
    db.commit()
    db.close()
    assert files.read_documents(spark, str(path)).count() == 25


def test_convert_drops_copies(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "a"}\n{"text": "a"}\n{"text": "b"}\n')
    files.convert(spark, f"{tmp_path}/a.jsonl", f"{tmp_path}/b.parquet")
    assert spark.read.parquet(f"{tmp_path}/b.parquet").count() == 2


def test_snapshot_tells_damage(spark, tmp_path):
    path = f"{tmp_path}/snap"
    snapshots.export(spark, {"docs": spark.createDataFrame(ROWS, DOC)}, path)
    assert snapshots.restore(spark, path)["docs"].count() == 2
    spark.createDataFrame(ROWS[:1], DOC).write.mode("overwrite").parquet(f"{path}/docs")
    with pytest.raises(ValueError, match="docs"):
        snapshots.restore(spark, path)


def test_project_dependencies(spark, tmp_path):
    (tmp_path / "web/node_modules/x").mkdir(parents=True)
    (tmp_path / "web/package.json").write_text('{"dependencies": {"left": "^1.2.0"}}')
    (tmp_path / "web/node_modules/x/package.json").write_text('{"dependencies": {"hidden": "1"}}')
    (tmp_path / "requirements.txt").write_text("NumPy==2.0\n# note\nplain\n")
    (tmp_path / "Cargo.toml").write_text('[dependencies]\nserde = "1"\ntokio = { version = "1.2" }\n')
    found = {(r["ecosystem"], r["package"], r["version"]) for r in projects.dependencies(spark, str(tmp_path)).collect()}
    assert found == {("npm", "left", "1.2.0"), ("pypi", "numpy", "2.0"), ("pypi", "plain", None), ("cargo", "serde", "1"), ("cargo", "tokio", "1.2")}


def test_sound(spark, tmp_path):
    with wave.open(f"{tmp_path}/a.wav", "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"".join(struct.pack("<h", int(9000 * math.sin(i / 9))) for i in range(16000)))
    v = media.sound_vectors(spark, str(tmp_path)).first()["embedding"]
    assert len(v) == media.DIM and sum(x * x for x in v) == pytest.approx(1)
    assert media.assets(spark, str(tmp_path)).first()["kind"] == "audio"


def test_worker_batches_can_be_repeated(spark, tmp_path):
    rows = spark.createDataFrame([(1, "we decided so"), (2, "plain")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/queue")
    stream = st.read_folder(spark, f"{tmp_path}/queue", rows.schema)
    for _ in range(2):
        st.extract_worker(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")
    assert sorted((r["doc_id"], r["memory_type"]) for r in found.collect()) == [(1, "decision"), (2, "fact")]


def test_late_events_drop_out(spark, tmp_path):
    def put(name, seconds):
        spark.createDataFrame([(s, "k", 1.0) for s in seconds], "s long, kind string, value double").select(F.timestamp_seconds("s").alias("ts"), "kind", "value").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        rows = spark.readStream.schema("ts timestamp, kind string, value double").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        st.tumbling(rows, "1 hour", "kind").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted((int(r["start"].timestamp()), r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put("1", [0, 100, 90_000])
    assert run() == [(0, 2)]
    put("2", [200, 95_000])
    assert run() == [(0, 2), (90_000, 1)] or run()[0] == (0, 2)
