"""Thin adapters over a store in the shapes that agent frameworks expect; none of them is imported."""

from __future__ import annotations

from recollex.operators.store import Store


class Retriever:
    """``invoke(query)`` gives documents as dicts with page_content and metadata."""

    def __init__(self, store: Store, *, mode: str = "lex", k: int = 4):
        self.store, self.mode, self.k = store, mode, k

    def invoke(self, query: str) -> list[dict]:
        hits = self.store.search(self.mode, query, self.k)
        rows = {r["id"]: r for r in self.store.get([i for i, _ in hits]).collect()}  # k documents
        return [{"page_content": rows[i]["text"], "metadata": {"id": i, "uri": rows[i]["uri"], "score": s}} for i, s in hits if i in rows]


class Memory:
    """add, search, get_all and delete for a user's memories, kept apart by uri."""

    def __init__(self, store: Store):
        self.store = store

    def add(self, texts: list[str], user: str) -> list[int]:
        first = self.store.query_one("select coalesce(max(id), 0) + 1 as n from docs")["n"]
        rows = [(first + i, f"memory://{user}/{first + i}", t) for i, t in enumerate(texts)]
        kept = self.store.put(self.store.spark.createDataFrame(rows, "id long, uri string, text string"))
        return sorted(r["id"] for r in kept.collect())

    def _own(self, user: str):
        from recollex.operators.predicates import not_deleted

        return not_deleted(self.store.docs().fillna({"meta": "{}"}), f"memory://{user}/")

    def get_all(self, user: str) -> list[dict]:
        return [{"id": r["id"], "memory": r["text"]} for r in self._own(user).orderBy("id").collect()]

    def search(self, query: str, user: str, k: int = 5) -> list[dict]:
        from recollex.operators import fulltext

        hits = fulltext.search(self._own(user), fulltext.compile_loose(query), k)
        return [{"id": r["id"], "score": r["score"]} for r in hits.collect()]

    def delete(self, ids: list[int]) -> int:
        return self.store.delete(self.store.spark.createDataFrame([(i,) for i in ids], "id long"))


class VectorStore:
    """add(ids, texts, embeddings) and query(embedding, k)."""

    def __init__(self, store: Store):
        self.store = store

    def add(self, ids: list[int], texts: list[str], embeddings: list[list[float]]) -> int:
        rows = [(i, t, [float(x) for x in v]) for i, t, v in zip(ids, texts, embeddings, strict=True)]
        return self.store.put(self.store.spark.createDataFrame(rows, "id long, text string, embedding array<float>")).count()

    def query(self, embedding: list[float], k: int = 4) -> list[tuple[int, float]]:
        return self.store.search("vec", "", k, query_vector=list(embedding))
