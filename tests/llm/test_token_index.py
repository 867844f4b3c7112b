import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recollex.llm import queries as Q
from recollex.llm import token_index as ti
from recollex.storage import new_path

from .helpers import docs

MODEL = Q.vocabulary("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_str(MODEL.decode())  # as it comes, apart from the encoder's own


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.sampled_from([*"ab 1'.\n\té漢　\x1f<|>s", "  ", "<|endoftext|>", " the"]), max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_units_encode_like_the_library(text):
    import pyarrow as pa

    encoder = ti.encoder_of(MODEL)
    want = np.array(plain(text), encoder.dtype).tobytes()
    assert encoder.encode(text) == want
    assert encoder.encode_all(pa.array([text, "", text], pa.string())) == [want, b"", want]


def test_the_string_of_an_added_token_is_that_token():
    assert plain("x<|endoftext|>") == [87, 50256]
    encoder = ti.encoder_of(MODEL)
    for text in ("x<|endoftext|>", "<|endoftext|>", " <|endoftext|> y ", "a<|endoftext|><|endoftext|>  b", "<|endoftext", "one two  <|endoftext|>\n\n three"):
        assert encoder.encode(text) == np.array(plain(text), encoder.dtype).tobytes()


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    index = ti.ShardIndex.load(ti.ShardIndex.build(keys, 0, np.full(len(keys), 3), "<u2").dump())
    assert sorted(index.mph.slots(keys)) == list(range(len(keys)))
    first, count = index.records(keys)
    assert (first == np.arange(len(keys))).all() and (count == 1).all()
    assert index.records(keys + 1)[1][~np.isin(keys + 1, keys)].sum() == 0


def test_repeated_keys_are_refused_by_the_hash():
    with pytest.raises(ValueError):
        ti.PerfectHash.build(np.array([5, 5]))


def read(spark, frame, **options):
    path = new_path(spark, "test-index")
    ti.write_dataset(frame, path, MODEL, **options)
    return path, sorted(ti.lookup(spark, path, frame).collect(), key=lambda r: (r["start"], r["n_tokens"]))


def test_round_trip_matches_brute_force(spark):
    texts = ["one two", None, "", "word " * 3000, "  lead", "x" * 5000, "tail  ", "é漢 \n\n z", "x<|endoftext|>", "a <|endoftext|> <|endoftext|>b c" + " d" * 2000]
    frame = docs(spark, texts, start=-3).repartition(3)
    path, found = read(spark, frame, docs_per_shard=2)
    start = 0
    for i, text in enumerate(texts):
        ids = [*plain(text), 2]
        row = found[i]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (i - 3, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert ti.lookup(spark, path, docs(spark, ["?"], start=99)).count() == 0


def test_null_and_repeated_keys_keep_all_records(spark):
    frame = spark.createDataFrame([(None, "a b"), (None, "c"), (7, "x"), (7, "x"), (7, "y z")], "doc_id long, text string")
    _, found = read(spark, frame)
    assert [r["doc_id"] for r in found] == [None, None, 7, 7, 7]
    assert [r["start"] for r in found] == [0, 2, 5, 7, 9]


def test_hot_keys_are_dealt_to_several_shards(spark):
    import json

    rows = [(5, f"copy {i}") for i in range(60)] + [(None, f"n{i}") for i in range(30)] + [(i, "z") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path, found = read(spark, frame, docs_per_shard=8)
    assert len(found) == 120 and [r["doc_id"] for r in found] == sorted((r["doc_id"] for r in found), key=lambda k: (k is not None, k))
    sizes = [r["n_docs"] for r in spark.read.parquet(f"{path}/manifest").collect()]
    assert max(sizes) <= 24 and sum(sizes) == 120
    start = 0
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    assert json.loads(open(path.removeprefix("file://") + "/bounds.json").read())


def test_empty_table_and_clashing_columns(spark):
    assert read(spark, docs(spark, []))[1] == []
    frame = docs(spark, ["a"]).selectExpr("*", "1 as shard", "2 as key", "3 as ids", "4 as start")
    assert len(read(spark, frame)[1]) == 1


def test_query_covers_every_document(spark, sf_dir):
    found = Q.op1_token_index(spark, sf_dir).collect()
    table = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"] for r in found} == set(table)
    start = 0
    for row in sorted(found, key=lambda r: r["doc_id"]):
        ids = [*plain(table[row["doc_id"]]), 2]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
