"""Benchmark decontamination by size-partitioned MinHash containment search, natively.

An item is found in a document if the document has at least ``threshold`` of the
item's distinct word shingles. MinHash of a whole document can't tell that: a
short item is a vanishing share of a long document. So items are sketched, each by
the ``picks`` shingles of its smallest hashes, and documents are asked what they
have of the sketches.

Search. Items are partitioned by size, in powers of two of their distinct
shingles. A partition knows its sketch size, the number of picks that a document
must have, and the number of words below which no document can hold any of its
items; documents below that never meet it. An item with no more shingles than
picks is its own sketch, and ``threshold`` of it must be there. Of larger items a
document that holds ``threshold`` of the shingles has fewer than the asked-for
picks with a chance below ``MISS``: the picks are drawn without replacement, and
the binomial tail bounds theirs. Documents' shingles meet the sketches alone, and
the pairs with enough picks are the candidates.

Verification. Candidate documents are read again, their shingles meet those of
the items, words against words, and the shared ones of candidate pairs are
counted. All other documents are done after the search.

A document's shingles are hashed and met with the items' where it is read, so its
text isn't shuffled. Items and candidates are broadcast while they are below a
checked count (``BROADCAST_SHINGLES`` item shingles, ``BROADCAST_PAIRS``
candidates); beyond that they are joined by a shuffle, in which a shingle that
many documents share is dealt to ``SALT`` tasks by document. Both ways are exact.

Words are the runs of letters and digits of the lower-cased text. Defined
results. A text of fewer words than a shingle has one shingle, all of its words,
and so matches texts of just these words alone; a text without words has none
and never matches. Null text counts as empty. Texts of any length are searched
whole. Items and documents with null ids are compared like others. Rows that
share an id, null included, are compared row by row, and a pair of ids is
returned once, with its greatest containment; repeated rows change nothing. An
empty table on either side gives no pairs. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.storage import materialize, small

WORDS = 5
THRESHOLD = 0.8
#: Shingles in the sketch of an item.
PICKS = 32
#: Chance to miss an item of just the required containment.
MISS = 1e-9
#: Largest number of item shingles that is broadcast: about 150 bytes each.
BROADCAST_SHINGLES = 400_000
#: Largest number of candidate pairs that is broadcast: two ids each.
BROADCAST_PAIRS = 500_000
#: Tasks that a shingle is dealt to where documents and items are shuffled.
SALT = 32
_SEPARATOR = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATOR), "")


def _shingles(texts: DataFrame, ids: list[str], n: int) -> DataFrame:
    """(ids..., w, at, words, shingle): a row and a 64-bit hash for each run of ``n`` words of the array ``w``.

    Words are hashed once, and a shingle is the hash of its words' hashes, which
    is compiled code over the arrays that each exploded row points into.
    """
    split = texts.select(*ids, words(F.col("text")).alias("w"))
    hashed = split.select(*ids, "w", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    at = hashed.select(*ids, "w", "h", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))))).alias("at"))
    part = [F.get("h", F.col("at") + i) for i in range(n)]  # null beyond a short text, which xxhash64 skips
    return at.select(*ids, "w", "at", F.size("w").alias("words"), F.xxhash64(F.least(F.size("w"), F.lit(n)), *part).alias("shingle"))


def _said(n: int) -> Column:
    """The words of a shingle."""
    return F.array_join(F.slice("w", F.col("at") + 1, n), " ")


def _name(key: str, text: str) -> Column:
    """What tells rows apart: id and text. A struct, so that nulls join."""
    return F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("mark"))


def _keyed(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    return rows.select(_name(key, text).alias(name), F.col(text).alias("text"))


def size_class(size: Column) -> Column:
    """Partition by size: the power of two at or below it."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def enough(picks: int, threshold: float, miss: float = MISS) -> int:
    """Picks that a holder of ``threshold`` of a larger item has, but with a chance of ``miss``; at least one."""
    tail, m = 0.0, 0
    while m < picks:
        tail += math.comb(picks, m) * threshold**m * (1 - threshold) ** (picks - m)
        if tail > miss:
            break
        m += 1
    return max(m, 1)


def item_shingles(items: DataFrame, *, key: str = "item_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """(item, size, shingle, said) of the distinct shingles of each item."""
    found = _shingles(_keyed(items, key, text, "item"), ["item"], n).select("item", "shingle", _said(n).alias("said")).distinct()
    return found.join(found.groupBy("item").agg(F.count(F.lit(1)).alias("size")), "item").select("item", "size", "shingle", "said")


def sketches(shingles: DataFrame, *, picks: int = PICKS, threshold: float = THRESHOLD) -> DataFrame:
    """(item, class, needed, least, shingle): the picks of each item, with what its partition by size asks of a document."""
    hashes = shingles.select("item", "size", "shingle").distinct()
    lowest = hashes.groupBy("item", "size").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("shingle", F.lit(1)).alias("h"), "shingle"))).alias("all"))  # of one item
    needed = F.when(F.col("size") <= picks, F.ceil(F.col("size") * threshold)).otherwise(F.lit(enough(picks, threshold)))
    classed = lowest.select("item", size_class(F.col("size")).alias("class"), needed.cast("int").alias("needed"), F.explode(F.slice("all", 1, picks)["shingle"]).alias("shingle"))
    return classed.withColumn("least", F.ceil(F.pow(F.lit(2.0), F.col("class")) * threshold).cast("int"))


def candidates(docs: DataFrame, sketched: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = WORDS, broadcast: bool = True, salt: int = SALT) -> DataFrame:
    """(doc, item) of documents with enough picks of an item."""
    rows = _shingles(_keyed(docs, key, text, "doc"), ["doc"], n)
    picks = sketched.withColumnRenamed("shingle", "pick")
    same = (F.col("shingle") == F.col("pick")) & (F.col("words") >= F.col("least"))
    if broadcast:
        met = rows.join(F.broadcast(picks), same)
    else:
        dealt = picks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        met = rows.select("doc", "words", "shingle", F.pmod(F.xxhash64("doc"), F.lit(salt)).cast("int").alias("own")).join(dealt, same & (F.col("own") == F.col("part")))
    held = met.groupBy("doc", "item", "needed", "shingle").agg(F.lit(1).alias("one"))
    return held.groupBy("doc", "item", "needed").agg(F.count(F.lit(1)).alias("n")).filter("n >= needed").select("doc", "item")


def held(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, picks: int = PICKS, broadcast_shingles: int = BROADCAST_SHINGLES, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc, item, size, n_shared) of rows that hold an item, each named by id and text."""
    own = materialize(item_shingles(items, key=item_key, text=item_text, n=n), "item-shingles")
    few = own.count() <= broadcast_shingles
    pairs = materialize(candidates(docs, sketches(own, picks=picks, threshold=threshold), key=key, text=text, n=n, broadcast=few), "candidates")
    asked = small(pairs, broadcast_pairs)
    texts = _keyed(docs, key, text, "doc").join(small(pairs.select("doc").distinct(), broadcast_pairs), "doc", "left_semi")
    rows = _shingles(texts, ["doc"], n)
    if few:
        ours = own.withColumnsRenamed({"shingle": "s", "said": "t"})
        met = rows.join(F.broadcast(ours), F.col("shingle") == F.col("s")).filter(_said(n) == F.col("t")).join(asked, ["doc", "item"], "left_semi")
    else:
        met = rows.select("doc", "shingle", _said(n).alias("said")).join(asked.join(own, "item"), ["doc", "shingle", "said"])
    shared = met.select("doc", "item", "size", "shingle").distinct().groupBy("doc", "item", "size").agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.filter(F.col("n_shared") >= F.ceil(F.col("size") * threshold))


def contained(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", item_key: str = "item_id", **options) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of items found in documents."""
    best = held(docs, items, key=key, item_key=item_key, **options).groupBy("doc.id", "item.id").agg(F.max(F.struct((F.col("n_shared") / F.col("size")).alias("containment"), "n_shared", "size")).alias("b"))
    return best.toDF("_doc", "_item", "b").select(F.col("_doc").alias(key), F.col("_item").alias(item_key), "b.n_shared", F.col("b.size").alias("n_item"), "b.containment")


def clean(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    found = materialize(held(docs, items, key=key, text=text, **options).select(F.col("doc").alias("_held")).distinct(), "leaks")
    return docs.join(small(found, BROADCAST_PAIRS), _name(key, text) == F.col("_held"), "left_anti")
