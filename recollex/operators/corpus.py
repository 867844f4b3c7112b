"""Corpus: sources, documents, chunks with byte spans, conversations, fetched pages, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.functions import text as tx


def put(docs: DataFrame, known: DataFrame | None = None, *, arrival: str = "id") -> DataFrame:
    """Documents whose text is new: the first arrival of each, with its hash; empty ids are kept as they are."""
    hashed = docs.withColumn("hash", F.sha2("text", 256))
    others = [c for c in hashed.columns if c != "hash"]
    first = hashed.groupBy("hash").agg(F.min_by(F.struct(*others), arrival).alias("d")).select("hash", "d.*")
    return first if known is None else first.join(known.select("hash"), "hash", "left_anti")


def put_batch_ids(docs: DataFrame, stored: DataFrame, *, arrival: str = "id") -> DataFrame:
    """(arrival, id): the id under which each document of a batch is stored; copies share one."""
    return docs.select(F.col(arrival).alias("arrival"), F.sha2("text", 256).alias("hash")).join(stored.select("hash", F.col("id")), "hash").select("arrival", "id")


def valid_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has the dimension and finite numbers alone."""
    v = F.col("embedding")
    return rows.filter((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def delete(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("id"), "id", "left_anti")


def chunks(docs: DataFrame) -> DataFrame:
    """(id, chunk, text, start, end): paragraphs between blank lines, trimmed, with their byte spans."""
    parts = F.split("text", "\n\n")
    rows = docs.select("id", F.posexplode(parts).alias("chunk", "raw"))
    before = F.coalesce(F.sum(F.octet_length("raw") + 2).over(Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.octet_length("raw") - F.octet_length(F.ltrim("raw"))
    out = rows.select("id", "chunk", F.trim("raw").alias("text"), (before + lead).alias("start"))
    return out.filter("text <> ''").withColumn("end", F.col("start") + F.octet_length("text"))


def web_documents(pages: DataFrame) -> DataFrame:
    """(id, uri, title, text) of fetched pages."""
    return pages.select(F.col("page_id").alias("id"), F.col("url").alias("uri"), tx.html_title(F.col("html"), F.col("url")).alias("title"), tx.strip_html(F.col("html")).alias("text"))


def fetched_kind(content_type: Column, body: Column) -> Column:
    """rss, pdf, html or text, by content type and then by how the body starts."""
    kind, start = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.ltrim(F.substring(body, 1, 200)))
    return (
        F.when(kind.rlike("rss|atom|xml") & ~kind.rlike("xhtml"), "rss").when(kind.rlike("pdf"), "pdf").when(kind.rlike("html"), "html")
        .when(start.startswith("%pdf"), "pdf").when(start.rlike(r"^(<\?xml[^>]*>\s*)?<(rss|feed)"), "rss").when(start.rlike(r"^<(!doctype html|html)"), "html").otherwise("text")
    )


def rss_items(feeds: DataFrame) -> DataFrame:
    """(uri, n, title, link, guid, text) of the items of feeds (uri, body)."""
    items = feeds.select("uri", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("n", "item"))

    def field(name: str) -> Column:
        raw = F.regexp_extract("item", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
        return F.trim(F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))

    body = F.when(field("content:encoded") != "", field("content:encoded")).otherwise(field("description"))
    return items.select("uri", "n", field("title").alias("title"), field("link").alias("link"), F.coalesce(F.nullif(field("guid"), F.lit("")), field("link")).alias("guid"), tx.strip_html(body).alias("text"))


def import_docs(docs: DataFrame, limit: int) -> DataFrame:
    """The newest documents as corpus documents; times beyond ten digits are milliseconds."""
    seconds = F.when(F.col("ts") > 9_999_999_999, F.floor(F.col("ts") / 1000)).otherwise(F.col("ts"))
    return docs.orderBy(F.desc("ts"), F.desc("id")).limit(limit).select("id", "uri", "title", seconds.alias("published_ts"))


def due_sources(sources: DataFrame, now: int, limit: int) -> DataFrame:
    """Polling sources whose interval has passed, never polled ones first."""
    return sources.filter((F.col("interval") > 0) & (F.coalesce("last_sync", F.lit(0)) + F.col("interval") <= now)).orderBy(F.coalesce("last_sync", F.lit(0)), "id").limit(limit)


WINDOW, STEP, LONG = 400, 350, 1000


def sweep(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, part, text): a chunk a message, long ones in overlapping windows, each with a prefix that tells where it is from."""
    rows = messages.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    prefix = F.concat(F.lit("["), "role", F.lit("|msg"), F.col("turn").cast("string"), F.lit("] "))
    starts = F.when(F.length("text") > LONG, F.sequence(F.lit(0), F.length("text") - 1, F.lit(STEP))).otherwise(F.array(F.lit(0)))
    size = F.when(F.length("text") > LONG, F.lit(WINDOW)).otherwise(F.length("text"))
    parts = F.transform(starts, lambda s: F.substring("text", s + 1, size))
    return rows.select("conv_id", "turn", F.posexplode(parts).alias("part", "piece"), prefix.alias("prefix")).select("conv_id", "turn", "part", F.concat("prefix", "piece").alias("text"))


def pack_paragraphs(docs: DataFrame, target: int = 2048, cap: int = 4096) -> DataFrame:
    """(id, pack, text): paragraphs joined until the target is reached; one beyond the cap is cut."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, part: Column) -> Column:
        joined = F.when(state["open"] == "", part).otherwise(F.concat(state["open"], F.lit("\n\n"), part))
        full = F.length(joined) >= target
        return F.struct(F.when(full, F.array_append(state["done"], F.substring(joined, 1, cap))).otherwise(state["done"]).alias("done"), F.when(full, F.lit("")).otherwise(joined).alias("open"))

    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")
    packed = F.aggregate(parts, empty, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return docs.select("id", F.posexplode(packed).alias("pack", "text"))
