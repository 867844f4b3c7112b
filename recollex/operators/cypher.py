"""A small Cypher: one-hop and longer matches, shortest paths, create, and two calls."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.operators import graph

_MATCH = re.compile(r"MATCH\s+\((\w+)\)-\[(?:\w*)(?::(\w+))?(?:\*(\d+)?(?:\.\.(\d+))?)?\]->\((\w+)\)\s+WHERE\s+id\((\w+)\)\s*=\s*(\d+)\s+RETURN\s+\w+(?:\s+LIMIT\s+(\d+))?\s*$", re.I)
_STAR = re.compile(r"\[[^\]]*\*", re.I)
_PATH = re.compile(r"SHORTEST\s+PATH\s+FROM\s+(\d+)\s+TO\s+(\d+)(?:\s+MAX\s+(\d+))?\s*$", re.I)
_CREATE = re.compile(r"CREATE\s+\((\d+)\)-\[:(\w+)(?:\s*\{\s*weight:\s*([0-9.]+)\s*\})?\]->\((\d+)\)\s*$", re.I)
_CALL = re.compile(r"CALL\s+(pagerank|communities)\(\s*(\d+)?\s*\)\s*$", re.I)


def parse(text: str) -> dict:
    """The operation that a query asks for. Relations are upper-cased; LIMIT is 10 unless told."""
    text = text.strip().rstrip(";")
    if m := _MATCH.match(text):
        _, rel, low, high, _, _, node, limit = m.groups()
        star = bool(_STAR.search(text))
        return {"op": "match", "rel": rel.upper() if rel else None, "node": int(node), "least": int(low or 1) if star else 1, "most": int(high or low or 3) if star else 1, "limit": int(limit or 10)}
    if m := _PATH.match(text):
        return {"op": "path", "from": int(m[1]), "to": int(m[2]), "most": int(m[3] or 6)}
    if m := _CREATE.match(text):
        return {"op": "create", "from": int(m[1]), "rel": m[2].upper(), "weight": float(m[3] or 1.0), "to": int(m[4])}
    if m := _CALL.match(text):
        return {"op": m[1].lower(), "limit": int(m[2] or 10)}
    raise ValueError(f"cannot parse: {text}")


def run(edges: DataFrame, text: str) -> DataFrame:
    """Result of a query; of CREATE, the edges with the new one."""
    q = parse(text)
    if q["op"] == "match":
        rows = edges if q["rel"] is None else edges.filter(F.upper("rel") == q["rel"])
        if q["most"] == 1:
            return graph.neighbors(rows, q["node"], q["limit"]).select(F.col("to_id").alias("id"), F.lit(1).alias("hop"))
        seeds = edges.sparkSession.range(1).select(F.lit(q["node"]).cast("long").alias("id"))
        return graph.hops(rows, seeds, q["most"]).filter(F.col("hop").between(q["least"], q["most"])).orderBy("hop", "id").limit(q["limit"])
    if q["op"] == "path":
        return graph.shortest_path(edges, q["from"], q["to"], q["most"])
    if q["op"] == "create":
        row = edges.sparkSession.range(1).select(F.lit(q["from"]).cast("long").alias("from_id"), F.lit(q["to"]).cast("long").alias("to_id"), F.lit(q["rel"]).alias("rel"), F.lit(q["weight"]).alias("weight"), F.lit(0).alias("seq"))
        return graph.relate(edges, row)
    if q["op"] == "pagerank":
        return graph.pagerank(edges).orderBy(F.desc(F.round("score", 12)), "id").limit(q["limit"])
    return graph.communities(edges).groupBy("label").agg(F.count(F.lit(1)).alias("members")).orderBy(F.desc("members"), "label").limit(q["limit"])
