from collections import Counter

import pytest

from recollex.llm import queries as Q
from recollex.llm import rollups as ro
from recollex.storage import new_path

CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, seq int"


def store(spark):
    return ro.RollupStore(spark, new_path(spark, "test-rollup"))


def totals(s):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in s.totals().collect()}


def brute(batches):
    live = {}
    for batch in batches:
        last = {}
        for op, doc, source, lang, tok, n, seq in batch:
            if doc is not None:
                key = (seq, op, source or "", lang or "", tok or "", n or 0)
                if doc not in last or key > last[doc][0]:
                    last[doc] = (key, (op, source, lang, tok, n or 0))
        for doc, (_, (op, *row)) in last.items():
            live.pop(doc, None)
            if op != "delete":
                live[doc] = row
    docs, tokens = Counter(), Counter()
    for source, lang, tok, n in live.values():
        docs[source, lang, tok] += 1
        tokens[source, lang, tok] += n
    return {k: (docs[k], tokens[k]) for k in docs}


BATCHES = [
    [("insert", i, f"s{i % 3}", "en", "v1", i, 1) for i in range(20)] + [("insert", 3, "s0", "en", "v1", 3, 0), ("insert", None, "s0", "en", "v1", 9, 1), ("insert", 50, None, None, None, None, 1)],
    [("revise", i, f"s{i % 3}", "en", "v2", 2 * i, 1) for i in range(0, 20, 2)] + [("delete", 5, None, None, None, 0, 1), ("delete", 999, None, None, None, 0, 1), ("revise", 77, "new", "de", "v2", 7, 1)],
    [("insert", 5, "back", "en", "v1", 1, 1), ("delete", 5, None, None, None, 0, 2), ("delete", 50, None, None, None, 0, 1)],
    [],
]


def test_deltas_match_a_recount_and_batches_count_once(spark):
    s, done = store(spark), []
    for n, batch in enumerate(BATCHES):
        frame = spark.createDataFrame(batch, CHANGES).selectExpr("*", "1 as sign", "2 as n_docs")
        assert s.apply(f"batch/{n}", frame) and not s.apply(f"batch/{n}", frame)
        done.append(batch)
        assert totals(s) == brute(done)
    s.compact()
    assert totals(s) == brute(done)
    assert s.apply("after", spark.createDataFrame([("insert", 1000, "z", "en", "v1", 4, 1)], CHANGES)) and totals(s)["z", "en", "v1"] == (1, 4)


@pytest.mark.parametrize("op", [None, "bogus"])
def test_unknown_ops_are_refused_whole(spark, op):
    s = store(spark)
    s.apply("a", spark.createDataFrame([("insert", 1, "x", "en", "v1", 5, 1)], CHANGES))
    with pytest.raises(ValueError):
        s.apply("b", spark.createDataFrame([(op, 1, "x", "en", "v1", 9, 2), ("insert", 2, "x", "en", "v1", 9, 2)], CHANGES))
    assert totals(s) == {("x", "en", "v1"): (1, 5)}
    assert s.apply("b", spark.createDataFrame([("insert", 2, "x", "en", "v1", 9, 2)], CHANGES)) and totals(s) == {("x", "en", "v1"): (2, 14)}


def test_compaction_keeps_documents_and_batch_ids(spark):
    s = store(spark)
    for n, batch in enumerate(BATCHES):
        s.apply(f"batch/{n}", spark.createDataFrame(batch, CHANGES))
    before = sorted(map(tuple, s.ledger().collect()), key=repr)
    s.compact()
    assert len(s._live()) == 1 and sorted(map(tuple, s.ledger().collect()), key=repr) == before
    assert not s.apply("batch/1", spark.createDataFrame(BATCHES[1], CHANGES))
    s.apply("gone", spark.createDataFrame([("delete", 77, None, None, None, 0, 1)], CHANGES))
    assert ("new", "de", "v2") not in totals(s)


def test_broken_off_batch_is_written_again(spark):
    s = store(spark)
    frame = spark.createDataFrame(BATCHES[0], CHANGES)
    broken = store(spark)
    broken.path, broken._commit = s.path, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        broken.apply("b", frame)
    assert totals(s) == {} and s.apply("b", frame) and totals(s) == brute(BATCHES[:1])


def test_empty_store(spark):
    s = store(spark)
    assert totals(s) == {} and s.ledger().count() == 0
    s.compact()


def counters():
    """Numbers of tokens as the libraries give them, without the engine's own encoders."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(Q.vocabulary("byte_bpe_50k.json").decode())
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Q.vocabulary("byte_bpe_multi_50k.tiktoken").splitlines())}
    encoding = tiktoken.Encoding("multi", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(library.encode(t, add_special_tokens=False).ids), lambda t: len(encoding.encode_ordinary(t))


def test_query_matches_a_recount(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    low = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").collect()}
    one, many = counters()
    want = {}
    for r in docs:
        if r["doc_id"] not in low:
            name, count = ("byte_bpe_50k", one) if r["lang"] == "en" else ("byte_bpe_multi_50k", many)
            n, t = want.get((r["source"], r["lang"], name), (0, 0))
            want[r["source"], r["lang"], name] = (n + 1, t + count(r["text"] or ""))
    found = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in Q.op10_token_rollup(spark, sf_dir).collect()}
    assert found == want
