"""A store of documents and vectors in a folder, with the calls that services and tools make.

Tables are folders of Parquet that are only appended to; what counts of a document
is its last row by ``version``. Reads are DataFrames, so a call costs what it reads.
"""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.operators import agent, events as ev, fulltext, learning, space
from recollex.storage import exists, materialize, new_path

DOCS = "id long, uri string, title string, text string, meta string, ts long, hash string, version long, deleted boolean"
VECTORS = "id long, embedding array<float>, version long"
QUERIES = "mode string, query string, k int, cached boolean, ts long"
MOST_CHARS = 1_000_000


class Store:
    """Opened on a folder, which is made if it isn't there."""

    def __init__(self, spark: SparkSession, path: str, *, cache: int = 128, stats_seconds: float = 60.0, dim: int = 64):
        self.spark, self.path, self.dim = spark, path, dim
        self._cache: OrderedDict = OrderedDict()
        self._most, self._ttl = cache, stats_seconds
        self._stats: tuple[float, dict] | None = None
        self.log: list[tuple] = []
        self.listeners: list = []

    def _table(self, name: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def _version(self) -> int:
        return (self._table("docs", DOCS).agg(F.max("version")).first()[0] or 0) + 1

    # --- reads

    def docs(self) -> DataFrame:
        rows = self._table("docs", DOCS)
        others = [c for c in rows.columns if c != "id"]
        last = rows.groupBy("id").agg(F.max_by(F.struct(*others), "version").alias("d")).select("id", "d.*")
        return last.filter("not deleted").drop("deleted", "version")

    def vectors(self) -> DataFrame:
        last = self._table("vectors", VECTORS).groupBy("id").agg(F.max_by("embedding", "version").alias("embedding"))
        return last.join(self.docs().select("id"), "id", "left_semi")

    def get(self, ids: list[int]) -> DataFrame:
        return self.docs().filter(F.col("id").isin(ids))

    def execute(self, sql: str, args: list | None = None) -> DataFrame:
        """Any SELECT over the views docs, vectors and those of attached tenants."""
        self.docs().createOrReplaceTempView("docs")
        self.vectors().createOrReplaceTempView("vectors")
        return self.spark.sql(sql, args=args or [])

    def query_one(self, sql: str, args: list | None = None):
        """The first row, or None."""
        return self.execute(sql, args).first()

    def attach(self, name: str, path: str) -> Store:
        """Another store's tables as views ``<name>_docs`` and ``<name>_vectors``, to read."""
        if not name.isidentifier():
            raise ValueError("a tenant's name is an identifier")
        other = Store(self.spark, path, dim=self.dim)
        other.docs().createOrReplaceTempView(f"{name}_docs")
        other.vectors().createOrReplaceTempView(f"{name}_vectors")
        return other

    # --- writes

    def put(self, rows: DataFrame, *, embed: bool = True) -> DataFrame:
        """Append documents (id, text; uri, title, meta, ts, embedding if there are); returns (id, hash) of what was new.

        Too long texts are refused, texts that are stored already are left out,
        and rows without a vector get one from the hashing embedder.
        """
        have = set(rows.columns)
        column = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
        wide = rows.select("id", column("uri", "string"), column("title", "string"), F.col("text"), column("meta", "string"), column("ts", "long"), column("embedding", "array<float>"))
        if not wide.filter(F.length("text") > MOST_CHARS).isEmpty():
            raise ValueError(f"a text has more than {MOST_CHARS} characters")
        hashed = wide.filter("id is not null and text is not null").withColumn("hash", F.sha2("text", 256))
        one = hashed.groupBy("hash").agg(F.min_by(F.struct(*[c for c in hashed.columns if c != "hash"]), "id").alias("d")).select("hash", "d.*")
        new = materialize(one.join(self.docs().select("hash"), "hash", "left_anti"), "put")
        version = self._version()
        self._append(new.select("id", "uri", "title", "text", "meta", "ts", "hash", F.lit(version).cast("long").alias("version"), F.lit(False).alias("deleted")), "docs")
        own = new.filter("embedding is not null").select("id", "embedding")
        if embed:
            made = learning.hash_embedding(new.filter("embedding is null").select("id", "text"), self.dim).select("id", "embedding")
            own = own.unionByName(made)
        self._append(own.withColumn("version", F.lit(version).cast("long")), "vectors")
        self._changed(new.count())
        for listener in self.listeners:
            listener("put", new.select("id", "uri", "title"))
        return new.select("id", "hash")

    def put_batches(self, batches: list[DataFrame]) -> list[int]:
        """Rows that were new in each batch."""
        return [self.put(b).count() for b in batches]

    def delete(self, ids: DataFrame) -> int:
        gone = materialize(self.docs().join(ids.select("id").distinct(), "id", "left_semi"), "delete")
        n = gone.count()
        self._append(gone.select("id", "uri", "title", F.lit(None).cast("string").alias("text"), "meta", "ts", "hash", F.lit(self._version()).cast("long").alias("version"), F.lit(True).alias("deleted")), "docs")
        self._changed(-n)
        return n

    def _changed(self, n: int) -> None:
        self._cache.clear()
        if self._stats is not None:
            at, stats = self._stats
            self._stats = at, stats | {"docs": stats["docs"] + n, "vectors": stats["vectors"] + n}

    # --- cached calls

    def stats(self) -> dict:
        """Numbers of documents and vectors, counted anew when older than the time to live and adjusted by writes between."""
        if self._stats is None or time.monotonic() - self._stats[0] > self._ttl:
            self._stats = time.monotonic(), {"docs": self.docs().count(), "vectors": self.vectors().count()}
        return dict(self._stats[1])

    def search(self, mode: str, query: str, k: int, *, query_vector: list[float] | None = None) -> list[tuple[int, float]]:
        """(id, score) of the best k; repeated calls are answered from the last results until something is written."""
        key = (mode, query, k, tuple(query_vector or ()))
        found = self._cache.get(key)
        self.log.append((mode, query, k, found is not None, int(time.time())))
        if found is None:
            hits = agent.search(self.docs(), mode, query, k, vecs=self.vectors(), query_vector=query_vector)
            found = [(r["id"], r["score"]) for r in hits.collect()]  # k rows
            self._cache[key] = found
            if len(self._cache) > self._most:
                self._cache.popitem(last=False)
        else:
            self._cache.move_to_end(key)
        return found

    def query_log(self) -> DataFrame:
        return self.spark.createDataFrame(self.log, QUERIES)

    def timeline(self, limit: int) -> DataFrame:
        return self.docs().orderBy(F.desc("ts"), F.desc("id")).limit(limit).select("id", "uri", "ts")

    def verify(self) -> DataFrame:
        """Documents whose hash isn't that of their text."""
        return fulltext.broken_hashes(self.docs()).select("id")

    def prime(self, terms: list[str], limit: int = 5) -> DataFrame:
        """(section, name, value): a brief for a session that begins: sizes, newest documents, hits for each term, what needs care."""
        docs = self.docs()
        sizes = self.spark.createDataFrame([("size", k, str(v)) for k, v in sorted(self.stats().items())], "section string, name string, value string")
        newest = docs.orderBy(F.desc("ts"), F.desc("id")).limit(limit).select(F.lit("newest").alias("section"), F.col("id").cast("string").alias("name"), F.coalesce("title", F.lit("")).alias("value"))
        out = sizes.unionByName(newest)
        for term in terms:
            hits = fulltext.search(docs, fulltext.compile_loose(term), limit)
            out = out.unionByName(hits.select(F.lit(f"term:{term}").alias("section"), F.col("id").cast("string").alias("name"), F.format_string("%.4f", "score").alias("value")))
        bad = self.verify().agg(F.count(F.lit(1)).alias("n")).select(F.lit("care").alias("section"), F.lit("broken_hashes").alias("name"), F.col("n").cast("string").alias("value"))
        return out.unionByName(bad)

    # --- requests

    def handle(self, request: dict) -> dict:
        """A request {"kind": ..., ...} as services get it; answers {"ok": ...} or {"error": ...}, rows as lists."""
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  of limited requests
        try:
            kind = request["kind"]
            body = {k: v for k, v in request.items() if k != "kind"}
            if kind == "ping":
                return {"ok": "pong"}
            if kind in ("put", "put_batch"):
                docs = self.spark.createDataFrame(body["docs"], "id long, uri string, title string, text string, ts long")
                return {"ok": self.put(docs).count()}
            if kind == "search":
                return {"ok": self.search(body.get("mode", "lex"), body["query"], int(body.get("k", 10)), query_vector=body.get("vector"))}
            if kind == "get":
                return {"ok": rows(self.get(body["ids"]))}
            if kind == "delete":
                return {"ok": self.delete(self.spark.createDataFrame([(i,) for i in body["ids"]], "id long"))}
            if kind == "stats":
                return {"ok": self.stats()}
            if kind == "timeline":
                return {"ok": rows(self.timeline(int(body.get("limit", 20))))}
            if kind == "verify":
                return {"ok": rows(self.verify())}
            if kind == "sql":
                return {"ok": rows(self.execute(body["sql"], body.get("args")).limit(int(body.get("limit", 1000))))}
            if kind == "log":
                return {"ok": rows(self.query_log())}
            if kind == "prime":
                return {"ok": rows(self.prime(body.get("terms", [])))}
            raise ValueError(f"kind {kind!r} isn't known")
        except Exception as error:  # a service answers every request
            return {"error": f"{type(error).__name__}: {error}"}


#: Tools that agents call, by name.
TOOLS = {
    "memory_search": agent.search, "memory_ground": agent.ground, "agent_observe": agent.observe, "agent_index": agent.index_in_scope, "context_pack": agent.context_pack, "rank_hits": agent.rank_hits,
    "session_ingest": agent.session_log, "session_replay": agent.session_replay, "queue_next": agent.next_batch, "queue_settle": agent.settle, "promotions": agent.ready_promotions,
    "daily_summary": ev.agent_summary, "health": ev.health, **space.TOOLS,
}


def call_tool(name: str, *args, **arguments):
    if name not in TOOLS:
        raise ValueError(f"tool {name!r} isn't known")
    return TOOLS[name](*args, **arguments)


def open_store(spark: SparkSession, path: str | None = None, **options) -> Store:
    """The store of a folder; a new one in the shared scratch folder without a path."""
    return Store(spark, path or new_path(spark, "store"), **options)


def tenant_filter(name: str) -> Column:
    """Rows of a tenant in tables that hold several."""
    return F.col("tenant") == name
