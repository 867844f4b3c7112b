import hashlib

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from recollex.llm import queries as Q
from recollex.llm import sentencepiece_bpe as sb

from .helpers import docs

MODEL = Q.vocabulary("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@given(st.lists(st.sampled_from([*"aabehtno ir\n\t▁19.,é漢字😀'<s>\x00", "  ", " the", "ing", "</s>", "<0x0A>"]), max_size=40).map("".join))
@settings(max_examples=500, deadline=None)
def test_same_ids_and_text_as_the_library(text):
    codec = sb.codec_of(MODEL)
    ids = codec.encode(text)
    assert ids == LIBRARY.encode(text)
    assert codec.decode([*ids, 2]) == LIBRARY.decode([*ids, 2])


def test_long_units_are_linear_and_exact():
    codec = sb.codec_of(MODEL)
    for text in ("a" * 30_000, "ababab" * 5_000, "é" * 3_000, " " * 5_000, "thethethe" * 3_000):
        assert codec.encode(text) == LIBRARY.encode(text)


def test_compatibility_is_what_merging_leaves():
    codec = sb.codec_of(MODEL)
    tokens = [codec.numbers[t] for t in ("a", "th", "he", "in", "ing", "er", "aa", "▁t", "n", "g")]
    for a in tokens:
        for b in tokens:
            text = codec.texts[a] + codec.texts[b]
            assert codec.fits(a, b) == (list(codec._unit(text)) == [codec.ids_of[a][0], codec.ids_of[b][0]])


def expected(text):
    ids = [*LIBRARY.encode(text or ""), 2]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))


def test_digest_of_odd_rows(spark):
    texts = ["", None, "a b", "a b", "x" * 9000, "long text " * 4000, "tab\tnl\n"]
    frame = docs(spark, texts).selectExpr("*", "1 as ids", "2 as key", "3 as n_tokens")
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sb.digest(frame, MODEL).collect()}
    assert found == {i: expected(t) for i, t in enumerate(texts)}
    assert sb.digest(docs(spark, []), MODEL).count() == 0


def test_columns_round_trip(spark):
    frame = sb.decode(sb.encode(docs(spark, ["hello  world", None]), MODEL), MODEL)
    assert [(r["ids"][-1], r["decoded"]) for r in frame.orderBy("doc_id").collect()] == [(2, "hello  world"), (2, "")]


def test_query_matches_the_library(spark, sf_dir):
    table = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in Q.op6_sentencepiece(spark, sf_dir).collect()}
    assert found == {k: expected(t) for k, t in table.items()}
