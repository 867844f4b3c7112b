"""Inverted index and BM25 in two dialects, phrases, prefixes, and fallbacks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from recollex.functions.text import tokens
from recollex.functions.porter import stem_column
from recollex.storage import materialize

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Query:
    """A compiled query: its terms, and whether all of them are needed."""

    terms: tuple[str, ...]
    all_terms: bool = False


def compile_query(text: str, most: int = 16) -> Query | None:
    """Plain words need all terms (OR between words needs any); other texts become at most ``most`` tokens, any of which will do."""
    if not text.strip():
        return None
    if re.fullmatch(r"[A-Za-z0-9_ ]+", text):
        words = text.split()
        terms = [w.lower() for w in words if w not in ("AND", "OR", "NOT")]
        return Query(tuple(dict.fromkeys(terms)), "OR" not in words)
    found = [t.lower() for t in re.findall(r"\w+", text) if len(t) > 1]
    return Query(tuple(dict.fromkeys(found))[:most], False)


def compile_loose(text: str) -> Query:
    """Any of the tokens; inner hyphens stay."""
    return Query(tuple(dict.fromkeys(re.findall(r"[\w-]+", text.lower()))), False)


def postings(docs: DataFrame, *, key: str = "id", fields: tuple[str, ...] = ("title", "text"), stem: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """(term, id, tf, dl): the inverted index. With ``stem`` terms are stemmed by Porter's rules.

    For the terms in ``only``, if given: others are left out in the row that has
    them, before anything is exploded or shuffled.
    """
    words = tokens(F.concat_ws(" ", *fields))
    rows = docs.select(F.col(key).alias("id"), words.alias("words"))
    kept = F.col("words") if only is None or stem else F.filter("words", lambda t: t.isin(*only))
    rows = rows.select("id", F.size("words").alias("dl"), F.explode(kept).alias("term"))
    if stem:
        rows = rows.withColumn("term", stem_column(F.col("term")))
    return rows.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def positions(docs: DataFrame, *, key: str = "id", field: str = "text") -> DataFrame:
    """(id, pos, term)."""
    return docs.select(F.col(key).alias("id"), F.posexplode(tokens(F.col(field))).alias("pos", "term"))


def bm25(index: DataFrame, corpus: DataFrame, queries: DataFrame, *, idf: str = "lucene", k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, score) of all documents that match.

    index: postings; corpus: (n, avgdl), one row; queries: (qid, term, needed)
    with needed the number of terms that a match must have. ``idf`` is lucene
    (always positive) or fts5 (with a floor just above zero).
    """
    asked = queries.select("term").distinct()
    live = index.join(F.broadcast(asked), "term")  # terms of queries, a few each
    df = live.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = live.join(df, "term").crossJoin(F.broadcast(corpus))  # one row
    ratio = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    weight = F.log1p(ratio) if idf == "lucene" else F.greatest(F.log(ratio), F.lit(1e-6))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    parts = scored.select("term", "id", part.alias("part"))
    return parts.join(F.broadcast(queries), "term").groupBy("qid", "id", "needed").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("hits")).filter("hits >= needed").select("qid", "id", "score")


def corpus_stats(docs: DataFrame, *, fields: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """(n, avgdl), one row."""
    return docs.select(F.size(tokens(F.concat_ws(" ", *fields))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def matched(docs: DataFrame, terms: tuple[str, ...], *, key: str = "id", fields: tuple[str, ...] = ("title", "text")) -> tuple[DataFrame, DataFrame]:
    """Postings of these terms, and (n, avgdl) of all documents, from one pass over the texts.

    The rows with a term are written to the shared folder while the sizes of all
    are observed, so texts are read and cut into words once.
    """
    seen = Observation()
    words = docs.select(F.col(key).alias("id"), tokens(F.concat_ws(" ", *fields)).alias("words"))
    rows = words.select("id", F.size("words").alias("dl"), F.filter("words", lambda t: t.isin(*terms)).alias("held"))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).filter(F.size("held") > 0)
    rows = materialize(rows, "matched")
    n, total = seen.get["n"], seen.get["words"]
    index = rows.select("id", "dl", F.explode("held").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return index, docs.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(total / n if n else 0.0).alias("avgdl"))


def query_frame(spark, queries: dict[int, Query]) -> DataFrame:
    rows = [F.struct(F.lit(qid).cast("long").alias("qid"), F.lit(t).alias("term"), F.lit(len(q.terms) if q.all_terms else 1).alias("needed")) for qid, q in queries.items() for t in q.terms]
    if not rows:
        return spark.range(0).selectExpr("id as qid", "cast(null as string) as term", "1 as needed")
    return spark.range(1).select(F.inline(F.array(*rows)))


def search(docs: DataFrame, query: str | Query, limit: int, *, idf: str = "lucene", fields: tuple[str, ...] = ("title", "text"), stem: bool = False) -> DataFrame:
    """(id, score): the best documents by BM25, ties to the smaller id. A blank query finds nothing."""
    spark = docs.sparkSession
    compiled = compile_query(query) if isinstance(query, str) else query
    if stem and compiled:
        from recollex.functions.porter import stem as stemmed

        compiled = Query(tuple(dict.fromkeys(stemmed(t) for t in compiled.terms)), compiled.all_terms)
    asked = query_frame(spark, {0: compiled} if compiled else {})
    if stem:
        index, corpus = postings(docs, fields=fields, stem=True), corpus_stats(docs, fields=fields)
    elif compiled and compiled.terms:
        index, corpus = matched(docs, compiled.terms, fields=fields)
    else:
        return spark.createDataFrame([], StructType([StructField("id", docs.schema["id"].dataType), StructField("score", DoubleType())]))
    hits = bm25(index, corpus, asked, idf=idf)
    return hits.select("id", "score").orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def search_batch(docs: DataFrame, queries: dict[int, Query], limit: int, **options) -> DataFrame:
    """(qid, rank, id, score) for many queries over one index."""
    terms = tuple(sorted({t for q in queries.values() for t in q.terms}))
    index, corpus = matched(docs, terms) if 0 < len(terms) <= 1000 else (postings(docs), corpus_stats(docs))
    hits = bm25(index, corpus, query_frame(docs.sparkSession, queries), **options)
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def phrase(docs: DataFrame, words: list[str], *, key: str = "id", field: str = "text") -> DataFrame:
    """(id, times): documents with the words next to each other in this order."""
    at = positions(docs, key=key, field=field).filter(F.col("term").isin(words))
    place = F.array(*[F.lit(w) for w in words])
    starts = at.select("id", "term", "pos").select("id", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(words) - 1)), lambda i: F.get(place, i) == F.col("term"))).alias("i"), "pos")
    return starts.groupBy("id", (F.col("pos") - F.col("i")).alias("start")).agg(F.countDistinct("i").alias("n")).filter(F.col("n") == len(words)).groupBy("id").agg(F.count(F.lit(1)).alias("times"))


def prefix(index: DataFrame, start: str) -> DataFrame:
    """(id, tf): documents with a term that starts so."""
    return index.filter(F.startswith("term", F.lit(start))).groupBy("id").agg(F.sum("tf").alias("tf"))


def like_search(rows: DataFrame, text: str, columns: list[str], limit: int, *, key: str) -> DataFrame:
    """Rows with the text in one of the columns, without case, newest (greatest) key first."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    return rows.filter(found).orderBy(F.desc(key)).limit(limit)


def newer_postings(docs: DataFrame, last_id: int) -> DataFrame:
    """Postings of the documents that an index up to ``last_id`` lacks."""
    return postings(docs.filter(F.col("id") > last_id))


def broken_hashes(docs: DataFrame) -> DataFrame:
    """Documents whose stored hash isn't that of their text."""
    return docs.filter(~F.col("hash").eqNullSafe(F.sha2("text", 256)))


def best_effort(docs: DataFrame, query: str, limit: int, hybrid=None) -> tuple[str, DataFrame]:
    """The first of lexical, hybrid and newest documents that finds anything, and its name."""
    found = search(docs, query, limit)
    if not found.isEmpty():
        return "lexical", found
    if hybrid is not None and not (found := hybrid(query, limit)).isEmpty():
        return "hybrid", found
    return "timeline", docs.orderBy(F.desc("ts"), F.desc("id")).limit(limit).select("id", F.lit(0.0).alias("score"))
