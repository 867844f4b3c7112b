"""Polled sources as a Spark data source: due ones are fetched by executors, and a restart goes on where it stopped.

    spark.dataSource.register(feeds.PolledFeeds)
    spark.readStream.format("polled_feeds").option("registry", path).load()
    spark.read.format("polled_feeds").option("registry", path).option("until", now).load()

The registry is a Parquet table (id long, uri string, interval long, in seconds).
Time is cut at the multiples of each source's interval, and a batch fetches the
sources with such a multiple after its first second and up to its last. The offset
of a batch is its last second. So nothing but that number has to be remembered: a
batch that is done again after a failure fetches the same sources, none is fetched
twice for one turn, and turns that passed while nobody polled are fetched once. All
sources are due at the start.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit
from urllib.request import urlopen

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id long, uri string, polled long, body string, error string"


def fetch(uri: str) -> str:
    """Text behind a web address, a file or all files of a folder in the order of their names."""
    if urlsplit(uri).scheme in ("http", "https"):
        with urlopen(uri, timeout=30) as answer:
            return answer.read().decode("utf-8", "replace")
    where, path = fs.FileSystem.from_uri(uri)
    found = where.get_file_info(path)
    names = [path] if found.type == fs.FileType.File else sorted(f.path for f in where.get_file_info(fs.FileSelector(path)) if not f.base_name.startswith((".", "_")))
    parts = []
    for name in names:
        with where.open_input_stream(name) as stream:
            parts.append(stream.read().decode("utf-8", "replace"))
    return "".join(parts)


@dataclass
class Share(InputPartition):
    """The due sources of one task: those whose id, without its sign, leaves ``part`` when divided by ``parts``."""

    part: int
    parts: int
    after: int
    until: int


class _Polls:
    def __init__(self, options: dict):
        if "registry" not in options:
            raise ValueError("polled_feeds needs the option registry, the folder of a Parquet table (id, uri, interval)")
        self.registry, self.parts = options["registry"], int(options.get("partitions", 8))
        if self.parts < 1:
            raise ValueError("partitions must be at least 1")

    def shares(self, after: int, until: int) -> list[Share]:
        return [Share(part, self.parts, after, until) for part in range(self.parts)] if until > after else []

    def due(self, share: Share) -> Iterator[tuple[int, str]]:
        """Sources of a share with a turn in its span; null or non-positive intervals, null ids and null uris are never due."""
        where, path = fs.FileSystem.from_uri(self.registry) if "://" in self.registry or self.registry.startswith("file:") else (fs.LocalFileSystem(), self.registry)
        every = ds.field("interval")
        rows = ds.dataset(path, filesystem=where, format="parquet", exclude_invalid_files=False)
        for batch in rows.to_batches(columns=["id", "uri", "interval"], filter=(every > 0) & ds.field("uri").is_valid() & ds.field("id").is_valid()):
            interval = batch["interval"].cast(pa.int64())
            turns = [pc.divide(pa.scalar(t, pa.int64()), interval) for t in (share.after, share.until)]
            rest = pc.abs(pc.subtract(batch["id"], pc.multiply(pc.divide(batch["id"], share.parts), share.parts)))
            mine = pc.equal(rest, share.part)
            turn = pc.greater(turns[1], turns[0]) if share.after > 0 else pc.is_valid(interval)
            some = batch.filter(pc.and_(mine, turn))
            yield from zip(some["id"].to_pylist(), some["uri"].to_pylist(), strict=True)

    def rows(self, share: Share) -> Iterator[tuple]:
        for number, uri in self.due(share):
            try:
                yield number, uri, share.until, fetch(uri), None
            except Exception as failure:  # one source that can't be reached doesn't stop the others; its row says why
                yield number, uri, share.until, None, f"{type(failure).__name__}: {failure}"[:500]


class FeedReader(_Polls, DataSourceReader):
    """One round: what is due at the second ``until`` if the last round was at ``after`` (never, if not given)."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.after, self.until = int(options.get("after", 0)), int(options.get("until", time.time()))

    def partitions(self) -> list[Share]:
        return self.shares(self.after, self.until) or [Share(0, 1, 0, 0)]

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.rows(partition) if partition.until else iter(())


class FeedStream(_Polls, DataSourceStreamReader):
    """Rounds from second to second; ``clock`` names a file that holds the second, where the machine's own isn't wanted."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.clock = options.get("clock")

    def initialOffset(self) -> dict:
        return {"second": 0}

    def latestOffset(self) -> dict:
        return {"second": int(fetch(self.clock)) if self.clock else int(time.time())}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.shares(start["second"], end["second"])

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.rows(partition)


class PolledFeeds(DataSource):
    """Format ``polled_feeds``: (id, uri, polled, body, error) of the sources that are due."""

    @classmethod
    def name(cls) -> str:
        return "polled_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStream(self.options)
