"""Joins of rows with facts about their key, where a few keys hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at most so many rows is never hot.
HOT_ROWS = 10_000
#: Most keys that are broadcast as hot, whatever the number of rows.
HOT_KEYS = 20_000


def join_facts(rows: DataFrame, facts: DataFrame, on: list[str], *, total: int, n: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, one row for each key, in which ``n`` counts the rows that have it.

    Hot keys hold more than ``HOT_ROWS`` rows and more than one in ``HOT_KEYS`` of
    all ``total`` rows, so there are at most ``HOT_KEYS`` of them: their facts are
    broadcast and their rows stay where they are. Other rows are shuffled.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    if total <= least:
        return rows.join(facts.drop(n), on)
    hot = facts.filter(F.col(n) > least).drop(n)
    few = F.broadcast(hot)  # at most HOT_KEYS rows
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts.filter(F.col(n) <= least).drop(n), on)
    return cold.unionByName(rows.join(few, on))
