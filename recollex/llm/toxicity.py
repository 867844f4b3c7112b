"""Toxicity classifier: character n-grams, scaled by naive Bayes log-count ratios.

A text is lower-cased and its runs of anything but letters become one space. Its
features are the distinct byte n-grams of the sizes in ``SIZES``, hashed to
``BUCKETS`` buckets. Training counts, for each bucket, the toxic and other texts
that have it; the log of the ratio of the smoothed shares scales the feature.
The ``FEATURES`` buckets that tell most are kept, and a logistic regression over
the scaled presences of these is fitted.

The classifier is fitted on at most ``MAX_TRAIN`` labelled texts, those with the
smallest hash of their key; a text in the sample is used whole. Counting runs on
the executors; the driver gets the kept buckets and, for each sampled text, which
of these it has.

Defined results. Null text counts as empty; empty texts are scored by the
intercept. Null keys are scored, but are never labelled and are held out of
nothing (held_out is false). Keys with several labels count as toxic if one says
so; rows without a label are ignored. Without labels, or with labels of one class
alone, the score is the smoothed share of toxic labels (0.5 without any).
Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.storage import materialize

SIZES = (4, 6, 8)
BUCKETS = 1 << 20
FEATURES = 1 << 12
#: Buckets seen in fewer sampled texts tell nothing.
LEAST_TEXTS = 2
MAX_TRAIN = 20_000
FOLDS = 5
SMOOTHING = 1.0
L2 = 1.0
ROUNDS = 200
THRESHOLD = 0.5
_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text, repeats included."""
    data = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode(), np.uint8).astype(np.uint32)
    out, rolled, n = [], data, 1
    while n < SIZES[-1] and len(rolled) > 1:
        n += 1
        rolled = rolled[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        if n in SIZES:
            mixed = rolled * np.uint32(0x9E3779B1) + np.uint32(n)
            out.append((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Classifier:
    """Weight of each kept bucket, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        """Position of each bucket among the kept ones, from 1; 0 for others."""
        out = np.zeros(BUCKETS, np.uint16)
        out[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return out


def present(text: str, table: np.ndarray) -> np.ndarray:
    """Positions of the kept buckets that a text has."""
    found = table[grams(text)]
    return np.unique(found[found > 0]) - 1


def held_out(key: str, folds: int = FOLDS) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, max_train: int = MAX_TRAIN, folds: int = FOLDS) -> DataFrame:
    """(text, toxic) of the labelled texts to learn from."""
    chosen = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key, folds))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.col(label).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(max_train)
    )
    texts = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "key")  # max_train rows of 16 bytes
    return found.groupBy("key").agg(F.min(F.struct("text", "toxic")).alias("r")).select("r.text", "r.toxic")  # a key once, so never more than max_train


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int32)
    texts = np.zeros(2, np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counts[toxic, np.unique(grams(text.as_py()))] += 1
            texts[toxic] += 1
    seen = np.flatnonzero(counts.any(axis=0)).astype(np.int32)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(seen, -1).astype(np.int32)), pa.array(np.append(counts[0, seen], texts[0]).astype(np.int64)), pa.array(np.append(counts[1, seen], texts[1]).astype(np.int64))],
        ["bucket", "other", "toxic"],
    )


def _fit_weights(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty by accelerated gradient descent."""
    lengths = np.array([len(r) for r in rows])
    columns = np.concatenate(rows).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    v, v_b, norm = np.ones(len(scale)), 1.0, 1.0
    for _ in range(12):  # largest eigenvalue of the Gram matrix, by power iteration
        z = np.bincount(owner, (v * scale)[columns], len(rows)) + v_b
        v, v_b = np.bincount(columns, z[owner], len(scale)) * scale, z.sum()
        norm = float(np.sqrt(v @ v + v_b**2))
        v, v_b = v / norm, v_b / norm
    step = 1.0 / (0.25 * 1.2 * norm + L2)
    weights, intercept = np.zeros(len(scale)), 0.0
    ahead, ahead_b, momentum = weights, intercept, 1.0
    for _ in range(ROUNDS):
        z = np.bincount(owner, (ahead * scale)[columns], len(rows)) + ahead_b
        error = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.bincount(columns, error[owner], len(scale)) * scale + L2 * ahead
        new, new_b = ahead - step * gradient, ahead_b - step * error.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / after * (new - weights)
        ahead_b = new_b + (momentum - 1) / after * (new_b - intercept)
        weights, intercept, momentum = new, new_b, after
    return weights * scale, float(intercept)


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN, folds: int = FOLDS) -> Classifier:
    """Fit on the labelled texts whose key isn't held out."""
    chosen = materialize(sample(docs, labels, key=key, text=text, label=label, max_train=max_train, folds=folds), "toxicity-sample")
    counts = chosen.mapInArrow(_count, "bucket int, other long, toxic long").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts, "toxicity-counts")
    totals = counts.filter("bucket = -1").first()
    others, toxics = (totals["other"], totals["toxic"]) if totals else (0, 0)
    if not others or not toxics:
        share = (toxics + 1) / (others + toxics + 2)
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    ratio = F.log((F.col("toxic") + SMOOTHING) / (toxics + 2 * SMOOTHING)) - F.log((F.col("other") + SMOOTHING) / (others + 2 * SMOOTHING))
    # How far the shares lie apart, in units of what chance would give.
    both = (F.col("toxic") + F.col("other")) / (others + toxics)
    told = F.abs(F.col("toxic") / toxics - F.col("other") / others) / F.sqrt(both * (1 - both) + 1e-3)
    kept = counts.filter((F.col("bucket") >= 0) & (F.col("other") + F.col("toxic") >= LEAST_TEXTS)).select("bucket", ratio.alias("ratio"), told.alias("told")).orderBy(F.desc("told"), "bucket").limit(FEATURES).toPandas()
    kept = kept.sort_values("bucket")
    model = Classifier(kept["bucket"].to_numpy(), np.zeros(len(kept)), 0.0)
    lookup = model.table()

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [present(t.as_py(), lookup).astype("<u2").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["found", "toxic"])

    rows = chosen.mapInArrow(which, "found binary, toxic int").toPandas()  # at most max_train rows of FEATURES bits
    weights, intercept = _fit_weights([np.frombuffer(r, "<u2") for r in rows["found"]], rows["toxic"].to_numpy(float), kept["ratio"].to_numpy())
    return Classifier(model.buckets, weights, intercept)


def score(docs: DataFrame, model: Classifier, *, text: str = "text", out: str = "score") -> DataFrame:
    """Add the column ``out``: chance that a text is toxic, from all of it."""
    buckets, weights, intercept = model.buckets, model.weights, model.intercept
    tables: list[np.ndarray] = []

    @F.pandas_udf("double")
    def run(texts):
        if not tables:
            tables.append(Classifier(buckets, weights, intercept).table())
        sums = np.array([weights[present(t or "", tables[0])].sum() for t in texts]) + intercept
        import pandas as pd

        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(sums, -30, 30))))

    return docs.withColumn(out, run(F.col(text)))
