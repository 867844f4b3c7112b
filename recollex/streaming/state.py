"""State of sessions and packs kept by key in the state store: typed values, maps, timers, time to live.

The state lives in RocksDB on the executors and is written with every batch below
the stream's checkpoint, so it may be larger than memory and outlives a lost
executor. A key's rows of a batch come in Arrow batches, never all at once, so a
key that holds a third of the rows costs time and not memory. Nothing is kept for
ever: a key's state goes by a timer of event time or by its time to live.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "10 minutes"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def typed_store(spark: SparkSession) -> None:
    """RocksDB as the state store, which typed state asks for; a setting of one's own stays."""
    if spark.conf.get(_STORE, "HDFSBackedStateStoreProvider").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SessionRows(StatefulProcessor):
    """A session's count, first and last second as a value, and its kinds as a map; a timer ends it when it is idle."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "n long, first long, last long")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")

    def _row(self, key, span, closed: bool) -> pd.DataFrame:
        kinds = {k[0]: v[0] for k, v in self.kinds.iterator()}
        return pd.DataFrame({"session_id": [key[0]], "n": [span[0]], "first": [span[1]], "last": [span[2]], "kinds": [kinds], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.span.get() if self.span.exists() else None
        n, first, last, kinds = *(old or (0, None, None)), Counter()
        for part in rows:
            low, high = int(part["seconds"].min()), int(part["seconds"].max())
            n, first, last = n + len(part), low if first is None else min(first, low), high if last is None else max(last, high)
            kinds.update(part["kind"].fillna("").value_counts().to_dict())
        for kind, more in kinds.items():
            self.kinds.updateValue((kind,), ((self.kinds.getValue((kind,))[0] if self.kinds.containsKey((kind,)) else 0) + int(more),))
        self.span.update((n, first, last))
        if old is None or old[2] != last:
            if old is not None:
                self.handle.deleteTimer((old[2] + self.idle) * 1000)
            self.handle.registerTimer((last + self.idle) * 1000)
        yield self._row(key, (n, first, last), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.span.exists():
            yield self._row(key, self.span.get(), True)
            self.span.clear()
            self.kinds.clear()

    def close(self) -> None:
        pass


def session_state(events: DataFrame, *, idle: int = 30 * 86400, late: str = LATE) -> DataFrame:
    """(session_id, n, first, last, kinds, closed) after each batch that touches a session, from events (session_id, kind, ts).

    ``closed`` rows come once ``idle`` seconds of event time passed after a session's
    last event; its state is gone then and a later event starts it anew. Events
    behind the watermark are left out, those without a session are a session of
    their own, events without a time are left out and a null kind counts as empty.
    """
    typed_store(events.sparkSession)
    rows = events.filter("ts is not null").withWatermark("ts", late).select("session_id", "kind", F.unix_seconds("ts").alias("seconds"), "ts")
    out = "session_id string, n long, first long, last long, kinds map<string,long>, closed boolean"
    return rows.groupBy("session_id").transformWithStateInPandas(SessionRows(idle), out, "update", "EventTime")


class PackCounts(StatefulProcessor):
    """How often a pack was shown and accepted; gone by a timer, or by its time to live where ``by_event`` is not set."""

    def __init__(self, keep: int, by_event: bool):
        self.keep, self.by_event = keep, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "n long, good long, last long", None if self.by_event else self.keep * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.counts.get() if self.counts.exists() else None
        n, good, last = old or (0, 0, None)
        for part in rows:
            high = int(part["seconds"].max())
            n, good, last = n + len(part), good + int(part["accepted"].fillna(0).sum()), high if last is None else max(last, high)
        self.counts.update((n, good, last))
        if self.by_event and (old is None or old[2] != last):
            if old is not None:
                self.handle.deleteTimer((old[2] + self.keep) * 1000)
            self.handle.registerTimer((last + self.keep) * 1000)
        yield pd.DataFrame({"pack_id": [key[0]], "shown": [n], "accepted": [good], "last": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def feedback_state(shown: DataFrame, *, keep: int = 3600, clock: str = "event", late: str = LATE) -> DataFrame:
    """(pack_id, shown, accepted, last): counts of each pack over the stream of (pack_id, accepted, ts).

    A pack's counts go ``keep`` seconds after its last row: by event time with
    ``clock="event"``, by the time to live of the stored value with
    ``clock="processing"``, for streams that go on: Spark runs batches without end
    under that clock, so a trigger of all that is available now would not stop. A null in ``accepted`` counts as not accepted; rows
    without a time are left out.
    """
    typed_store(shown.sparkSession)
    rows = shown.filter("ts is not null").withWatermark("ts", late).select("pack_id", F.col("accepted").cast("int").alias("accepted"), F.unix_seconds("ts").alias("seconds"), "ts")
    return rows.groupBy("pack_id").transformWithStateInPandas(PackCounts(keep, clock == "event"), "pack_id string, shown long, accepted long, last long", "update", "EventTime" if clock == "event" else "ProcessingTime")
