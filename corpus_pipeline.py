"""Corpus cleaning: toxicity, near-duplicates, benchmark leaks, secrets, token ids.

Each stage takes documents (doc_id, text and whatever else they have) and returns
the rows it keeps, in the same columns; the last one returns their token ids.

Defined results of every stage: null text counts as empty and is kept by all (a
text is never null in the end only if it was not at the start); nulls in other
columns pass through; texts of any length are handled whole; a stage over an empty
table gives an empty one; repeated rows are judged alike, and only the second
stage drops them; further columns pass through the first four stages, whatever
their names, but for names that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm import decontaminate, secrets, sentencepiece_bpe, simhash, toxicity
from recollex.llm.queries import vocabulary
from recollex.session import small_batches, table
from recollex.storage import materialize, new_path, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a classifier fitted on the labels. Empty texts are scored by its intercept."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="__score").filter(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that with the smallest id, then text; ids that clash or are null don't matter.

    Texts without words are one group, as their fingerprints are linked.
    """
    small_batches(spark)
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, told row by row."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked and their length counted anew; no row is dropped."""
    clean = secrets.redact(docs, secrets.fit(secrets.findings(spark)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document beside its columns, with digests of the ids and of what they decode to."""
    small_batches(spark)
    return sentencepiece_bpe.encoded(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]

#: Learned and tokenizing stages can't be written in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        docs = materialize(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return docs
