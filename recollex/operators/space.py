"""Spaces: wings hold rooms, rooms hold drawers; a drawer is a document under its place's uri."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.functions import text as tx
from recollex.operators import fulltext, fusion, vectors

SCHEME = "space://"


def slug(name: Column) -> Column:
    """A name as part of a uri: lower-case letters and digits, dashes between."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def place(space: Column, wing: Column | None = None, room: Column | None = None, drawer: Column | None = None) -> Column:
    """The uri of a place; deeper parts may be left out from the end."""
    parts = [slug(p) for p in (space, wing, room, drawer) if p is not None]
    return F.concat(F.lit(SCHEME), F.array_join(F.array(*parts), "/"))


def create(names: DataFrame) -> DataFrame:
    """(uri, kind, parent): the places that (space, wing, room) rows name, each once."""
    levels = [("space", [F.col("space")]), ("wing", [F.col("space"), F.col("wing")]), ("room", [F.col("space"), F.col("wing"), F.col("room")])]
    out = None
    for kind, parts in levels:
        named = names.filter(F.coalesce(F.trim(parts[-1]), F.lit("")) != "")
        parent = place(*parts[:-1]) if len(parts) > 1 else F.lit(None).cast("string")
        part = named.select(place(*parts).alias("uri"), F.lit(kind).alias("kind"), parent.alias("parent"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def put(drawers: DataFrame) -> DataFrame:
    """(id, uri, title, text): drawers (id, space, wing, room, title, text) as documents; empty texts are refused."""
    uri = place(F.col("space"), F.col("wing"), F.col("room"), F.col("id").cast("string"))
    return drawers.filter(F.coalesce(F.trim("text"), F.lit("")) != "").select("id", uri.alias("uri"), "title", "text")


def within(docs: DataFrame, under: str) -> DataFrame:
    """Drawers of a place and of all below it."""
    return docs.filter(F.startswith("uri", F.lit(under.rstrip("/") + "/")))


def listing(docs: DataFrame) -> DataFrame:
    """(space, wing, room, drawers)."""
    parts = F.split(F.substring("uri", len(SCHEME) + 1, 1_000_000), "/")
    rows = docs.filter(F.startswith("uri", F.lit(SCHEME))).select(F.get(parts, F.lit(0)).alias("space"), F.get(parts, F.lit(1)).alias("wing"), F.get(parts, F.lit(2)).alias("room"))
    return rows.groupBy("space", "wing", "room").agg(F.count(F.lit(1)).alias("drawers"))


def search(docs: DataFrame, query: str, k: int, *, under: str | None = None, vecs: DataFrame | None = None, query_vector: list[float] | None = None) -> DataFrame:
    """(id, score): lexical, or fused with the nearest vectors if a query vector is given."""
    inside = docs if under is None else within(docs, under)
    lex = fulltext.search(inside, query, k if not query_vector else 3 * k)
    if not query_vector:
        return lex
    near = vectors.knn(vecs.join(inside.select("id"), "id", "left_semi"), query_vector, 3 * k)
    return fusion.rrf([fusion.ranked(lex, "fts"), fusion.ranked(near, "vec", by="distance", descending=False)], k)


def search_reranked(docs: DataFrame, query: str, k: int, *, pool: int = 50, **options) -> DataFrame:
    """(id, score): the best of a pool of at least k, by the share of the query's words that a drawer holds, then by its first score."""
    found = search(docs, query, max(pool, k), **options)
    graded = found.join(docs.select("id", "text"), "id").withColumn("grade", tx.grade(F.lit(query), F.col("text")))
    return graded.select("id", (F.col("grade") + F.col("score") / 1000).alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


#: Names by which tools reach these operators.
TOOLS = {"space_create": create, "space_put": put, "space_list": listing, "space_within": within, "space_search": search, "space_search_reranked": search_reranked, "space_place": place}


def dispatch(tool: str, **arguments):
    if tool not in TOOLS:
        raise ValueError(f"tool {tool!r} is none of {sorted(TOOLS)}")
    return TOOLS[tool](**arguments)
