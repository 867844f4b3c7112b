import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from recollex.llm import simhash as sh  # noqa: E402

from .helpers import docs  # noqa: E402
from .test_decontaminate import brute as leaks  # noqa: E402
from .test_sentencepiece import expected  # noqa: E402
from .test_simhash import brute_components, brute_fingerprint  # noqa: E402


def test_stages_match_plain_versions(spark, sf_dir):
    """Each stage against a plain version on what the one before it kept."""
    stages = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()]

    kept = stages["toxicity"](spark, table, sf_dir).cache()
    assert kept.columns == table.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    gone = table.join(kept, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.filter("toxic = 1").count() >= 0.9 * gone.count() and gone.count() > 0

    apart = stages["near_duplicates"](spark, kept, sf_dir).cache()
    classes = brute_components({r["doc_id"]: brute_fingerprint(r["text"]) for r in kept.collect()})
    assert {r["doc_id"] for r in apart.collect()} == {k for k, c in classes.items() if k == c} and apart.columns == table.columns

    texts = {r["doc_id"]: r["text"] for r in apart.collect()}
    keys = sorted(texts)
    held = {keys[d] for d, *_ in leaks([texts[k] for k in keys], items)}
    clean = stages["decontamination"](spark, apart, sf_dir).cache()
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - held

    masked = stages["secrets"](spark, clean, sf_dir).cache()
    assert masked.columns == table.columns and masked.count() == clean.count()
    assert masked.filter(F.col("text").rlike('(?i)token = "[0-9a-f]{40}')).count() == 0
    assert masked.join(clean.select("doc_id", F.col("text").alias("old")), "doc_id").filter("text <> old and not contains(text, '[SECRET]')").count() == 0
    assert masked.filter("n_chars <> length(text)").count() == 0

    last = stages["sentencepiece"](spark, masked, sf_dir)
    assert last.columns == [*table.columns, "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert last.filter("size(ids) <> n_tokens or ids_sha256 <> sha2(array_join(ids, ' '), 256)").count() == 0
    assert last.select("doc_id", "text").exceptAll(masked.select("doc_id", "text")).count() == 0
    want = {r["doc_id"]: expected(r["text"]) for r in masked.collect()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in last.collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == set(want)


def test_odd_rows_pass_through(spark, sf_dir):
    frame = docs(spark, ["", None, "plain words of no harm at all in here", "plain words of no harm at all in here"])
    frame = frame.unionByName(spark.createDataFrame([(None, "no id", "en", "s", 5), (2, "plain words of no harm at all in here", "en", "s", 1)], frame.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf_dir).cache()
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sorted((r["doc_id"] for r in frame.collect()), key=str) == [0, 2, None]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), sf_dir).count() == 0


def test_rows_that_clash_on_an_id_are_kept_apart(spark, sf_dir):
    one, two = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "lorem ipsum dolor sit amet consectetur adipiscing elit sed do"
    frame = docs(spark, []).unionByName(spark.createDataFrame([(1, one, "en", "s", 1), (1, two, "en", "s", 1), (2, one, "en", "s", 1), (3, two, "en", "s", 1), (None, two, "en", "s", 1), (None, one + " lambda mu", "en", "s", 1), (1, one, "en", "s", 0)], docs(spark, []).schema))
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, sf_dir).collect()
    apart = sh.near_duplicates(frame.filter("doc_id is null")).select("fingerprint").distinct().count()
    assert apart == 2 and {(1, one, 0), (1, two, 1)} <= {(r["doc_id"], r["text"], r["n_chars"]) for r in kept} and len(kept) <= 3


def test_links_are_those_of_the_operator(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, sf_dir).count()
    assert kept == sh.near_duplicates(frame).select("component_id").distinct().count()
