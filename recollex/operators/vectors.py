"""Vector search: exact, quantised, cascaded, clustered, sparse and late interaction."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollex.functions import scores
from recollex.operators.selection import select_ranks
from recollex.session import small_batches
from recollex.storage import few, materialize


def knn(vectors: DataFrame, query: list[float], k: int, *, metric: str = "cosine") -> DataFrame:
    """(id, distance): the k nearest to one vector. A zero or empty query finds nothing; other dimensions are left out."""
    q = F.array(*[F.lit(float(x)) for x in query]) if query else F.array().cast("array<double>")
    rows = vectors.filter(F.size("embedding") == len(query))
    if not any(query):
        rows = rows.limit(0)
    distance = {"cosine": 1 - scores.cosine(F.col("embedding"), q), "l2": F.sqrt(scores.l2_squared(F.col("embedding"), q)), "dot": -scores.dot(F.col("embedding"), q)}[metric]
    return rows.select("id", distance.alias("distance")).orderBy(F.round("distance", 9), "id").limit(k)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, *, dim: int, metric: str = "cosine", block: int = 2048) -> DataFrame:
    """(qid, rank, id, distance) for each query, exact; ties go to the smaller id.

    Both sides are packed into rows of at most ``block`` vectors. A row of queries
    meets a row of vectors as one matrix product in some task, which keeps the k
    nearest of each query over all its products, so that a tile adds little, and hands
    them on at its end; a window with a group limit merges them. All is one job,
    and nothing but a count passes through the driver. Queries of at most
    ``BROADCAST_BYTES`` go to all tasks; more are dealt, and the packed vectors are
    then written once and read again for each partition of queries. Null vectors,
    those of other dimensions and those with null entries take no part.
    """
    asked = materialize(_packed(queries.select(F.col("qid").alias("id"), "embedding"), dim, block).toDF("qids", "queries"), "knn-queries")
    held = _packed(vectors.select("id", "embedding"), dim, block)
    if few(asked, max(BROADCAST_BYTES // (8 * block * (dim + 1)), 1)):
        tiles = held.crossJoin(F.broadcast(asked))  # packed rows
    else:
        tiles = asked.hint("shuffle_replicate_nl").crossJoin(materialize(held, "knn-vectors"))  # packed rows
    found = tiles.mapInPandas(_nearest_in_tiles(dim, k, metric), "qid long, id long, distance double")
    order = Window.partitionBy("qid").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "id", "distance")


#: Packed queries of a neighbour join that are sent to all tasks.
BROADCAST_BYTES = 64 << 20


def _packed(rows: DataFrame, dim: int, block: int) -> DataFrame:
    """(ids, matrix): vectors in ascending order of id within a row, as bytes of 64-bit integers and doubles."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            kept.append(batch)
            while sum(map(len, kept)) >= block:
                whole = pd.concat(kept)
                kept = [whole.iloc[block:]]
                yield _bytes(whole.iloc[:block])
        if sum(map(len, kept)):
            yield _bytes(pd.concat(kept))

    valid = rows.filter((F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull()))
    return valid.mapInPandas(pack, "ids binary, matrix binary")


def _bytes(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("id")
    return pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "matrix": [np.stack(part["embedding"].to_list()).astype(np.float64).tobytes()]})


#: Hits that a task holds of the query rows it has met; beyond that the earliest are handed on.
HELD_HITS = 4_000_000


def _nearest_in_tiles(dim: int, k: int, metric: str):
    """The k nearest of each query in all tiles of a task: a tile only adds what isn't farther than the k-th held so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple] = {}
        hits = lambda key, kept: pd.DataFrame({"qid": np.frombuffer(key, np.int64)[kept[0]], "id": kept[1], "distance": kept[2]})
        for batch in batches:
            for tile in batch.itertuples(index=False):
                q, x = np.frombuffer(tile.queries).reshape(-1, dim), np.frombuffer(tile.matrix).reshape(-1, dim)
                ids, kept = np.frombuffer(tile.ids, np.int64), held.pop(tile.qids, None)
                if kept is None:
                    d = np.round(_distances(q, x, metric), 9)
                    row, near = _least(d, min(k, d.shape[1]))
                    held[tile.qids] = _ranked(row, ids[near], d[row, near], k, len(q))
                else:
                    held[tile.qids] = _nearer(q, x, ids, kept, k, metric)
                while len(held) > 1 and sum(len(h[0]) for h in held.values()) > HELD_HITS:
                    first = next(iter(held))
                    yield hits(first, held.pop(first))
        for key, kept in held.items():
            yield hits(key, kept)

    return run


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    dots = q @ x.T
    if metric == "l2":
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * dots, 0))
    if metric == "dot":
        return -dots
    length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
    return 1 - np.divide(dots, length, out=np.zeros_like(dots), where=length > 0)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1)[:, None]
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _nearer(q: np.ndarray, x: np.ndarray, ids: np.ndarray, kept: tuple, k: int, metric: str) -> tuple:
    """What is kept of queries, (row, id, distance, the k-th distance of each row), with a tile's vectors that come as near."""
    last = kept[3]
    if metric == "cosine":
        # Floats of 32 bits rule out, within their error; the rest is measured in 64.
        u, v = _unit(q), _unit(x)
        bound = (1 - last - 1.2e-7 * (q.shape[1] + 8) - 1e-8).astype(np.float32)
        row, near = np.nonzero(~(u.astype(np.float32) @ v.astype(np.float32).T < bound[:, None]))
        d = np.round(1 - np.einsum("ij,ij->i", u[row], v[near]), 9)
    else:
        d = np.round(_distances(q, x, metric), 9)
        row, near = np.nonzero(~(d > last[:, None]))
        d = d[row, near]
    good = ~(d > last[row])
    if not good.any():
        return kept
    row, near, d = row[good], near[good], d[good]
    return _ranked(np.concatenate([kept[0], row]), np.concatenate([kept[1], ids[near]]), np.concatenate([kept[2], d]), k, len(q))


def _ranked(row: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int, n: int) -> tuple:
    """The first k of each row by distance, then id; and the k-th distance, infinite where there are fewer or it is none."""
    order = np.lexsort((ids, d, row))
    row, ids, d = row[order], ids[order], d[order]
    taken = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, ids, d = row[taken], ids[taken], d[taken]
    ends, last = np.searchsorted(row, np.arange(n), side="right"), np.full(n, np.inf)
    full = np.bincount(row, minlength=n) == k
    last[full] = d[ends[full] - 1]
    return row, ids, d, np.where(np.isnan(last), np.inf, last)


def _least(d: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the m least values of each row; of equal ones the first."""
    last = np.partition(d, m - 1, axis=1)[:, m - 1 : m]
    less, same = d < last, d == last
    taken = less | (same & (np.cumsum(same, axis=1, dtype=np.int32) <= m - less.sum(1, keepdims=True)))
    return np.nonzero(taken)


# --- quantised --------------------------------------------------------------


def hamming_knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, distance): fewest differing signs."""
    own = scores.sign_words(F.col("embedding"), len(query))
    other = scores.sign_words(F.array(*[F.lit(float(x)) for x in query]), len(query))
    return vectors.select("id", scores.hamming(own, other).cast("int").alias("distance")).orderBy("distance", "id").limit(k)


def int8_knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score): greatest product of 8-bit codes, scaled back."""
    q = F.array(*[F.lit(float(x)) for x in query])
    product = F.aggregate(F.zip_with(scores.int8(F.col("embedding")), scores.int8(q), lambda a, b: (a * b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    score = product * scores.int8_scale(F.col("embedding")) * scores.int8_scale(q)
    return vectors.select("id", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def cascade(vectors: DataFrame, query: list[float], k: int, *, first: int | None = None, rescore: str = "cosine") -> DataFrame:
    """Nearest by signs first, then the exact distance (or 8-bit product) of these."""
    pool = hamming_knn(vectors, query, first or max(4096, 64 * k)).select("id")
    near = vectors.join(F.broadcast(pool), "id")  # at most ``first`` ids
    return int8_knn(near, query, k) if rescore == "int8" else knn(near, query, k)


def truncated_knn(vectors: DataFrame, query: list[float], k: int, dims: int) -> DataFrame:
    """Nearest by the first dimensions alone."""
    head = vectors.select("id", F.slice("embedding", 1, dims).alias("embedding"))
    return knn(head, list(query)[:dims], k)


def codebook(vectors: DataFrame) -> DataFrame:
    """(dim, low, high) of each dimension."""
    return vectors.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """An orthogonal matrix: signs by a rule of the seed, then the Walsh-Hadamard matrix, over the next power of two."""
    size = 1 << max(dim - 1, 0).bit_length()
    i = np.arange(size)
    signs = np.where((i * 2654435761 * (2 * seed + 1) >> 16) & 1, -1.0, 1.0)
    hadamard = np.where(np.bitwise_count(i[:, None] & i[None, :]) % 2, -1.0, 1.0)
    return (hadamard * signs / math.sqrt(size))[:, :dim]


def rotated_signs(vectors: DataFrame, dim: int, seed: int = 7) -> DataFrame:
    """(id, bits, norm): signs after the rotation, packed to bytes."""
    turn = rotation(dim, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["embedding"].to_list()).astype(np.float64) if len(batch) else np.zeros((0, dim))
            packed = np.packbits(x @ turn.T >= 0, axis=1)
            yield pd.DataFrame({"id": batch["id"], "bits": [p.tobytes() for p in packed], "norm": np.linalg.norm(x, axis=1)})

    return vectors.select("id", "embedding").mapInPandas(run, "id long, bits binary, norm double")


def rotated_knn(vectors: DataFrame, query: list[float], k: int, *, pool: int = 1000, seed: int = 7) -> DataFrame:
    """Estimate from rotated signs, then the exact distance of the best ``pool``."""
    dim = len(query)
    turned = rotation(dim, seed) @ np.array(query, float)
    size = len(turned)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch["bits"]), np.uint8).reshape(len(batch), -1)
            signs = np.unpackbits(raw, axis=1)[:, :size].astype(np.float64) * 2 - 1
            yield pd.DataFrame({"id": batch["id"], "estimate": signs @ turned * batch["norm"].to_numpy() / np.sqrt(size)})

    near = rotated_signs(vectors, dim, seed).mapInPandas(run, "id long, estimate double").orderBy(F.desc(F.round("estimate", 9)), "id").limit(pool).select("id")
    return knn(vectors.join(F.broadcast(near), "id"), query, k)


def rotated_pairs(left: DataFrame, right: DataFrame, dim: int, seed: int = 7) -> DataFrame:
    """(a, b, estimate): the angle's cosine between vectors with the same ``pair``, told from rotated signs of both alone.

    Half of the turn that the share of differing signs makes; left and right: (pair, id, embedding).
    """
    size = len(rotation(dim, seed))
    own = left.join(rotated_signs(left, dim, seed).select("id", "bits"), "id").select("pair", F.col("id").alias("a"), F.col("bits").alias("x"))
    other = right.join(rotated_signs(right, dim, seed).select("id", "bits"), "id").select("pair", F.col("id").alias("b"), F.col("bits").alias("y"))

    @F.pandas_udf("int")
    def differ(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([int(np.bitwise_count(np.frombuffer(p, np.uint8) ^ np.frombuffer(q, np.uint8)).sum()) for p, q in zip(x, y, strict=True)], dtype="int32")

    return own.join(other, "pair").select("a", "b", F.cos(F.lit(math.pi) * differ("x", "y") / size).alias("estimate"))


def route(target_recall: float) -> str:
    """Search that reaches a recall: the cascade, a graph, or signs first."""
    return "cascade" if target_recall >= 0.98 else "graph" if target_recall >= 0.94 else "signs"


# --- clustered --------------------------------------------------------------


def ivf_build(vectors: DataFrame, clusters: int, path: str, *, seed: int = 1):
    """Write the vectors by cluster; return the fitted centres as (cluster, centre) rows on the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=clusters, seed=seed, maxIter=10, distanceMeasure="cosine").fit(rows)
    model.transform(rows).select("id", "embedding", F.col("prediction").alias("cluster")).repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(path)
    return [np.asarray(c) for c in model.clusterCenters()]


def ivf_search(spark, path: str, centres: list[np.ndarray], query: list[float], k: int, *, probes: int = 4) -> DataFrame:
    """Exact search in the folders of the nearest centres alone."""
    q = np.array(query)
    near = sorted(range(len(centres)), key=lambda i: -float(centres[i] @ q) / (np.linalg.norm(centres[i]) or 1))[:probes]
    return knn(spark.read.parquet(path).filter(F.col("cluster").isin(near)), query, k)


def plane_buckets(vectors: DataFrame, dim: int, *, planes: int = 8, seed: int = 3) -> DataFrame:
    """Add bucket: signs against random planes, as a number."""
    normals = np.random.default_rng(seed).standard_normal((planes, dim))
    out = F.lit(0)
    for i, plane in enumerate(normals):
        side = scores.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in plane])) > 0
        out = out + F.when(side, F.lit(1 << i)).otherwise(F.lit(0))
    return vectors.withColumn("bucket", out)


#: Vectors in a tile of a bucket, about.
TILE = 512


def consolidate(vectors: DataFrame, dim: int, *, threshold: float = 0.95, tile: int = TILE, **options) -> DataFrame:
    """(keep, drop, cosine): pairs of one bucket above the threshold.

    A bucket's vectors are dealt to tiles, and two tiles are compared as one matrix
    product, so that vectors are not repeated for each pair. Null vectors, those of
    other dimensions and those with null entries take no part.
    """
    valid = vectors.filter((F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull()))
    rows = plane_buckets(valid.select(F.col("id").cast("long").alias("id"), "embedding"), dim, **options)
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    dealt = rows.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col("tiles")).alias("tile"), "id", F.col("embedding").cast("array<double>").alias("embedding"))
    tiles = materialize(dealt.groupBy("bucket", "tile").applyInArrow(_as_tile, "bucket int, tile long, ids binary, matrix binary"), "tiles")
    other = tiles.select("bucket", F.col("tile").alias("tile2"), F.col("ids").alias("ids2"), F.col("matrix").alias("matrix2"))
    met = tiles.join(other, "bucket").filter("tile <= tile2").select((F.col("tile") == F.col("tile2")).alias("same"), "ids", "matrix", "ids2", "matrix2")
    return met.mapInArrow(_above(dim, threshold), "keep long, drop long, cosine double")


def _as_tile(rows: pa.Table) -> pa.Table:
    """A tile's ids and its vectors of length 1 (or 0), as bytes."""
    x = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    return pa.table({"bucket": rows.column("bucket")[:1], "tile": rows.column("tile")[:1], "ids": pa.array([rows.column("id").to_numpy().tobytes()], pa.binary()), "matrix": pa.array([unit.tobytes()], pa.binary())})


def _above(dim: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same, *parts = (c[i].as_py() for c in batch.columns)
                a, b = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[2], np.int64)
                cosine = np.frombuffer(parts[1]).reshape(-1, dim) @ np.frombuffer(parts[3]).reshape(-1, dim).T
                near = cosine > threshold
                row, column = np.nonzero(near & (a[:, None] < b[None]) if same else near & (a[:, None] != b[None]))
                x, y = a[row], b[column]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(cosine[row, column])], ["keep", "drop", "cosine"])

    return run


# --- sparse and late interaction --------------------------------------------


def sparse_encode(docs: DataFrame, *, text: str = "text", top: int | None = None) -> DataFrame:
    """(id, term, weight): 1 + ln(tf) of all terms, or of the ``top`` heaviest; a stand-in for a learned encoder."""
    from recollex.functions.text import tokens

    rows = docs.select("id", F.explode(tokens(F.col(text))).alias("term")).groupBy("id", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("weight"))
    if top is None:
        return rows
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    return rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def sparse_rows(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(id, entries (term, weight)): the vector of ``sparse_encode`` of each document as one row, counted within it, so that nothing but texts of repeated ids is shuffled."""
    from recollex.functions.text import tokens

    words = docs.select(F.col("id").cast("long").alias("id"), tokens(F.col(text)).alias("words")).filter("id is not null")
    again = docs.groupBy(F.col("id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    if not again.isEmpty():
        several = words.join(again, "id", "left_semi").groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words"))
        words = words.join(again, "id", "left_anti").unionByName(several)
    small_batches(docs.sparkSession)
    return words.mapInArrow(_counted, "id long, entries array<struct<term: string, weight: double>>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, entries) of rows (id, words): 1 + ln of how often a row has a word."""
    for batch in batches:
        words = batch.column("words")
        coded = pc.dictionary_encode(words.flatten())
        row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        size = max(len(coded.dictionary), 1)
        key, times = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        entries = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(1 + np.log(times))], ["term", "weight"])
        ends = np.searchsorted(key, np.arange(len(words) + 1) * size).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), entries)], ["id", "entries"])


#: Entries of the vocabulary that words are expanded into, and entries a word.
EXPANDED, SPREAD = 30_522, 4


def sparse_expand(docs: DataFrame, *, text: str = "text", top: int | None = None) -> DataFrame:
    """(id, term, weight): each distinct word spread over ``SPREAD`` entries by its hashes, sums of ln(1 + share), all or the ``top`` heaviest; where no learned encoder is plugged in."""
    from recollex.functions.text import tokens

    words = docs.select("id", F.array_distinct(tokens(F.col(text))).alias("words"))
    again = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("_id"))
    if not again.isEmpty():
        same = F.col("id").eqNullSafe(F.col("_id"))
        several = words.join(again, same, "left_semi").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
        words = words.join(again, same, "left_anti").unionByName(several)
    small_batches(docs.sparkSession)
    sums = words.select(F.col("id").cast("long").alias("id"), "words").mapInArrow(_spread, "id long, term long, weight double")
    if top is None:
        return sums
    order = Window.partitionBy("id").orderBy(F.desc(F.round("weight", 9)), "term")
    return sums.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, term, weight) of rows (id, words): summed within the row, so that nothing is shuffled."""
    for batch in batches:
        words = batch.column("words")
        coded = pc.dictionary_encode(words.flatten())
        named = coded.dictionary.to_pylist()
        digests = b"".join(hashlib.md5(f"{w}:{j}".encode()).digest()[:8] for w in named for j in range(SPREAD))
        numbers = np.frombuffer(digests, ">u4").astype(np.int64).reshape(len(named), SPREAD, 2)
        entry, weight = numbers[:, :, 0] % EXPANDED, np.log1p(numbers[:, :, 1] / 2.0**32)
        code = coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        key, at = np.unique((row[:, None] * EXPANDED + entry[code]).ravel(), return_inverse=True)
        summed = np.bincount(at, weights=weight[code].ravel(), minlength=len(key))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(key // EXPANDED)), pa.array(key % EXPANDED), pa.array(summed)], ["id", "term", "weight"])


def sparse_search(index: DataFrame, query: dict[str, float], k: int) -> DataFrame:
    """(id, score): greatest sum of products over shared terms, exact."""
    rows = [F.struct(F.lit(t).alias("term"), F.lit(float(w)).alias("q")) for t, w in sorted(query.items())]
    asked = index.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return index.join(F.broadcast(asked), "term").groupBy("id").agg(F.sum(F.col("weight") * F.col("q")).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


MOST_QUERY_TOKENS = 1024


def max_sim(query_tokens: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """(id, score): for each token of the query the best product with a token of the document, summed.

    query_tokens: (token, embedding), at most ``MOST_QUERY_TOKENS``, which is checked; doc_tokens: (id, token, embedding).
    """
    if not few(query_tokens, MOST_QUERY_TOKENS):
        raise ValueError(f"a query has more than {MOST_QUERY_TOKENS} tokens")
    pairs = doc_tokens.select("id", F.col("embedding").alias("d")).crossJoin(F.broadcast(query_tokens.select(F.col("token").alias("qt"), F.col("embedding").alias("q"))))
    best = pairs.groupBy("id", "qt").agg(F.max(scores.dot(F.col("q"), F.col("d"))).alias("best"))
    return best.groupBy("id").agg(F.sum("best").alias("score"))


def bucket_sums(doc_tokens: DataFrame, dim: int, *, planes: int = 3, seed: int = 5) -> DataFrame:
    """(id, fde): token vectors summed by the side of random planes they lie on, joined and normalised."""
    normals = np.random.default_rng(seed).standard_normal((planes, dim))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["embedding"].to_list()).astype(float)
        at = (x @ normals.T > 0) @ (1 << np.arange(planes))
        sums = np.zeros((1 << planes, dim))
        np.add.at(sums, at, x)
        flat = sums.ravel()
        length = np.linalg.norm(flat)
        return pd.DataFrame({"id": [key[0]], "fde": [(flat / length if length else flat).tolist()]})

    return doc_tokens.groupBy("id").applyInPandas(run, "id long, fde array<double>")


# --- recall guarantees ------------------------------------------------------


def conformal_quantile(residuals: DataFrame, alpha: float) -> DataFrame:
    """(q,): the residual that 1 - alpha of new ones won't exceed, exact; none without residuals."""
    n = F.col("n")
    place = F.greatest(F.ceil(F.least((1 - alpha) * (1 + 1 / n), F.lit(1.0)) * n - 1e-9), F.lit(1))
    return select_ranks(residuals, [], "residual", {"q": place - 1}).select("q")


def needs_exact(q: float, target_recall: float) -> bool:
    """Whether the bound on recall (1 - q) misses the target, so that exact search is due."""
    return min(max(1 - q, 0.0), 1.0) < target_recall
