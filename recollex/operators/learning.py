"""Learning from use: rewards, bandits, calibration, drift, logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollex.functions import scores


def rewards(log: DataFrame, *, arm: str) -> DataFrame:
    """(arm, wins, losses) of a log with the columns arm and hit (0 or 1)."""
    return log.groupBy(F.col(arm).alias("arm")).agg(F.sum(F.col("hit").cast("long")).alias("wins"), F.sum(1 - F.col("hit").cast("long")).alias("losses"))


def kind_bonuses(log: DataFrame) -> DataFrame:
    return rewards(log, arm="kind").select(F.col("arm").alias("kind"), scores.kind_bonus(F.col("wins"), F.col("losses")).alias("bonus"))


def pick(arms: dict[str, tuple[int, int]], candidates: list[str], seed: int) -> str | None:
    """Thompson sampling: the candidate with the greatest draw of Beta(wins, losses); unknown ones are Beta(1, 1)."""
    if not candidates:
        return None
    rng = np.random.default_rng(seed)
    draws = {c: rng.beta(*(max(x, 1e-9) for x in arms.get(c, (1, 1)))) for c in candidates}
    return max(candidates, key=lambda c: (draws[c], c))


ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9)


def pick_alpha(arms: dict[str, tuple[int, int]], shape: int, seed: int) -> tuple[int, float]:
    """Number and value of the blend to try for a query shape."""
    names = [f"{shape}:{i}" for i in range(len(ALPHAS))]
    at = names.index(pick(arms, names, seed))
    return at, ALPHAS[at]


def sweep_unaccepted(log: DataFrame, now: int, timeout: int) -> DataFrame:
    """(misses,): one miss if anything shown longer ago than the timeout was not accepted, however many there are."""
    stale = log.filter("accepted is null").filter(F.col("ts") < now - timeout)
    return stale.agg(F.least(F.count(F.lit(1)), F.lit(1)).alias("misses"))


def calibrate(hits: DataFrame, corrections: DataFrame) -> DataFrame:
    """Scores times the correction of their bucket (bucket, correction), within 0 and 1."""
    rows = hits.withColumn("bucket", scores.bucket(F.col("score")))
    return rows.join(corrections, "bucket", "left").withColumn("score", scores.calibrated(F.col("score"), F.col("correction"))).drop("correction")


def corrections(judged: DataFrame) -> DataFrame:
    """(bucket, correction): share of good hits over the mean score of each bucket. judged: (score, good)."""
    rows = judged.withColumn("bucket", scores.bucket(F.col("score")))
    return rows.groupBy("bucket").agg((F.avg(F.col("good").cast("double")) / F.nullif(F.avg("score"), F.lit(0.0))).alias("correction"))


def drift(stored: DataFrame, fresh: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(mean_cosine, status), one row, over a sample of ``n`` ids."""
    chosen = stored.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
    both = chosen.join(fresh.select("id", F.col("embedding").alias("fresh")), "id")
    mean = both.agg(F.avg(scores.cosine(F.col("embedding"), F.col("fresh"))).alias("mean_cosine"))
    return mean.withColumn("status", F.when(F.col("mean_cosine") >= 0.98, "ok").when(F.col("mean_cosine") >= 0.9, "warn").otherwise("error"))


def libsvm(log: DataFrame) -> DataFrame:
    """(line,): label, query number and features of a click log (query_text, bm25, vec, rank, score, clicked)."""
    # Distinct queries alone are numbered in one task; the log is joined with them.
    numbered = log.select("query_text").distinct().withColumn("qid", F.row_number().over(Window.orderBy("query_text")))
    rows = log.join(numbered, "query_text")
    return rows.select(F.format_string("%d qid:%d 1:%.6f 2:%.6f 3:%d 4:%.6f", F.col("clicked").cast("int"), "qid", "bm25", "vec", F.col("rank").cast("int"), "score").alias("line"))


def to_embed(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts that the cache of embeddings (hash, embedding) lacks."""
    return texts.select("text", F.sha2("text", 256).alias("hash")).dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti")


def hash_embedding(texts: DataFrame, dim: int = 64) -> DataFrame:
    """Add embedding: signed counts of hashed words, normalised; a stand-in for a model."""
    import pandas as pd

    from recollex.operators.packing import fnv1a
    from recollex.session import small_batches

    small_batches(texts.sparkSession)

    @F.pandas_udf("array<float>")
    def run(column):
        out = []
        for t in column:
            v = np.zeros(dim, np.float32)
            for word in (t or "").lower().split():
                h = fnv1a(word.encode())
                v[h % dim] += 1 if h >> 63 else -1
            length = np.linalg.norm(v)
            out.append((v / length if length else v).tolist())
        return pd.Series(out)

    return texts.withColumn("embedding", run("text"))


# --- rerankers --------------------------------------------------------------


def rerank(hits: DataFrame, *, second: str | None = None, first: int = 100, k: int = 10) -> DataFrame:
    """The first ``first`` hits blended with a second score (a column), or as they are."""
    top = hits.orderBy(F.desc("score"), "id").limit(first)
    if second is not None:
        top = top.withColumn("score", scores.rerank_blend(F.col(second), F.col("score")))
    return top.orderBy(F.desc(F.round("score", 12)), "id").limit(k)
