"""Quality rules of documents and of their hosts.

Rules fail documents by measures of their whole texts; what fails is counted by
host (domain, source). A host's rate of failed documents is drawn to that of all
hosts by a beta prior that is fitted to the hosts themselves: of two hosts with the
same share, the one with few documents is trusted less to be bad. Documents of a
host whose drawn rate is over ``MAX_RATE`` go, the others go by their own base
rules alone.

Words are runs of anything but space, tab, and the controls up to carriage return.
Measures: ``n_words``; ``word_chars``, code points in words; ``n_symbols``;
``n_dup_lines``, lines with a word that equal an earlier line;
``n_repeat_words``, words that lie in a run of ``WINDOW`` words which the text
holds twice or more.

The prior. With pooled rate m, H hosts and N documents, the spread of the hosts'
rates around m, weighted by documents, less what chance alone gives, is
``v = sum(n * (rate - m)**2) / N - H * m * (1 - m) / N``. The prior's weight is
``s = m * (1 - m) / v - 1`` documents (0 at least), and a host with n documents of
which f fail has the rate ``(f + m * s) / (n + s)``. Without spread beyond chance
all hosts have the rate m.

Texts are read once and the measures written; hosts are counted in each task before
anything is shuffled, so a host that holds a third of all documents is a row a task.
Verdicts come back by broadcast if the rejected hosts are few (counted), else by
``skew.join_facts``.

Defined results. Null text counts as empty: it has no words and fails. A null host
is no host: its documents are left to the base rules. Texts of any length are
measured whole. Repeated rows count each, and get equal verdicts; an empty table
gives an empty one. Other columns stay; those with the names of measures and
verdicts are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.llm.skew import join_facts
from recollex.storage import BROADCAST_ROWS, few, materialize

WINDOW = 5
LEAST_WORDS = 10
#: Most words in repeated windows, in percent of all.
MOST_REPEATED = 20
#: Rules that count for a host only: symbols in percent of words, repeated lines in percent of words, mean word length.
MOST_SYMBOLS = 10
MOST_DUP_LINES = 10
MEAN_WORD = (2, 16)
#: A host with a greater rate of failed documents is rejected.
MAX_RATE = 0.5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words within windows that are there twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    # Windows are numbered by the numbers of a shorter one and the word after it.
    own = ids
    for size in range(2, window + 1):
        pairs = own[: len(words) - size + 1] * len(number) + ids[size - 1 :]
        own = np.unique(pairs, return_inverse=True)[1]
    again = np.bincount(own)[own] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[window : window + n] -= again
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measures(text: str, window: int = WINDOW) -> tuple[int, int, int, int, int]:
    """The measures of one text, in the order of ``MEASURES``."""
    words = text.encode().split()  # bytes are split at just these six spaces
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words, window)


def measure(docs: DataFrame, *, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add the measures, as long."""
    kind = "struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array([measures(t.as_py() or "", window) for t in texts], np.int64).reshape(-1, len(MEASURES))
            yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(MEASURES))], list(MEASURES))

    own = "__measures"
    while own in docs.columns:
        own += "_"
    found = docs.withColumn(own, run(F.col(text)))
    return found.select(*[c for c in docs.columns if c not in MEASURES], *[F.col(own)[m].alias(m) for m in MEASURES])


def base_failed() -> Column:
    """The rules that fail a document for itself."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def any_failed() -> Column:
    """The rules that count against a host."""
    words = F.col("n_words")
    odd = (100 * F.col("n_symbols") > MOST_SYMBOLS * words) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * words)
    return base_failed() | odd | (F.col("word_chars") < MEAN_WORD[0] * words) | (F.col("word_chars") > MEAN_WORD[1] * words)


def host_rates(measured: DataFrame, *, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n, failed, rate, rejected) of each host."""
    counts = materialize(measured.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(any_failed().cast("long")).alias("failed")), "hosts")
    total = counts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares")).first()
    if not total["n"]:
        return counts.select("host", "n", "failed", F.lit(0.0).alias("rate"), F.lit(False).alias("rejected"))
    pooled = total["failed"] / total["n"]
    chance = pooled * (1 - pooled)
    spread = (total["squares"] - total["failed"] * pooled - total["hosts"] * chance) / total["n"]
    if spread > 0:
        weight = max(chance / spread - 1, 0.0)
        rate = (F.col("failed") + F.lit(pooled * weight)) / (F.col("n") + F.lit(weight))
    else:
        rate = F.lit(pooled)
    return counts.select("host", "n", "failed", rate.alias("rate"), (rate > max_rate).alias("rejected"))


def decide(measured: DataFrame, hosts: DataFrame, *, host: str = "source") -> DataFrame:
    """Add base_failed and kept to measured documents."""
    columns = [c for c in measured.columns if c not in ("base_failed", "kept", "host_rejected")]
    rows = measured.select(*columns, base_failed().alias("base_failed"))
    same, count = "__host", "__host_n"
    while {same, count} & set(columns):
        same, count = same + "_", count + "_"
    bad = hosts.filter("rejected").select(F.col("host").alias(same), F.lit(True).alias("host_rejected"))
    if few(bad, BROADCAST_ROWS):
        told = rows.join(F.broadcast(bad), F.col(host) == F.col(same), "left").drop(same)
    else:
        facts = hosts.select(F.col("host").alias(same), F.col("rejected").alias("host_rejected"), F.col("n").alias(count))
        total = hosts.agg(F.sum("n")).first()[0]
        known = join_facts(rows.filter(F.col(host).isNotNull()).withColumn(same, F.col(host)), facts, [same], total=total, n=count).drop(same)
        told = known.unionByName(rows.filter(F.col(host).isNull()).withColumn("host_rejected", F.lit(False)))
    rejected = F.coalesce("host_rejected", F.lit(False))
    return told.select(*columns, "base_failed", rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))


def judge(docs: DataFrame, *, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Documents without their text, with measures, base_failed, host_rejected and kept.

    To keep the texts, and read them twice: ``decide(measure(docs), host_rates(measure(docs)))``.
    """
    measured = materialize(measure(docs, text=text).drop(text), "measures")
    return decide(measured, host_rates(measured, host=host, max_rate=max_rate), host=host)
