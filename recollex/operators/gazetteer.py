"""Names of a gazetteer in texts by a prefix tree of words, kept as a table.

The tree has a row for each beginning of a name: its words, how many they are, and
the names that end there. Texts are cut into words with their places; a place whose
word begins some name stays, and word by word the places whose words so far are in
the tree stay on. Each step is a join of the places that are left with one level of
the tree, so the work follows the text and the matches and not the number of names.

Of the names at a place the longest counts, and of overlapping ones the leftmost:
runs of overlapping names are told by one running maximum of ends, and within a run
(mostly of one name) they are taken in order.
"""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollex.session import small_batches
from recollex.storage import materialize, small

WORD = re.compile(r"\w+")
SPAN = "array<struct<start: int, end: int, text: string>>"


def spans(pattern: str, column: str = "text", *, lower: bool = False):
    """Column of the places (in characters) and texts of what a pattern finds, in order."""
    found = re.compile(pattern)

    @F.arrow_udf(SPAN)
    def run(texts: pa.Array) -> pa.Array:
        # Numbers in packed arrays, not an object for each place.
        starts, ends, offsets, parts = array("i"), array("i"), array("i", [0]), []
        for t in texts:
            text, words = t.as_py() or "", []
            for m in found.finditer(text):
                starts.append(m.start())
                ends.append(m.end())
                words.append(m.group().lower() if lower else m.group())
            offsets.append(len(starts))
            parts.append(pa.array(words, pa.string()))
        words = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), words], names=["start", "end", "text"]))

    return run(F.col(column))


def tree(names: DataFrame) -> DataFrame:
    """(prefix, depth, name, kind) of names (name, kind): a row for each beginning of a name, in words; ``name`` (lower-cased) and ``kind`` where one ends.

    Names without words are left out; names that only differ in case are one, with the smallest kind.
    """
    cut = names.filter("name is not null").select(F.lower(F.regexp_replace("name", r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")).alias("name"), "kind")
    cut = cut.filter("name <> ''").groupBy("name").agg(F.min("kind").alias("kind"))
    words = cut.withColumn("words", F.filter(F.split("name", r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    steps = words.select("name", "kind", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("depth"))
    ends = F.col("depth") == F.size("words")
    prefix = F.array_join(F.slice("words", F.lit(1), F.col("depth")), " ")
    return steps.select(prefix.alias("prefix"), "depth", F.when(ends, F.struct("name", "kind")).alias("end")).groupBy("prefix", "depth").agg(F.collect_set("end").alias("ends"))


def find(docs: DataFrame, names: DataFrame, *, key: str = "id", text: str = "text") -> DataFrame:
    """(key, start, end, kind, text): names in texts, leftmost-longest, without case, on whole words. What stands between a name's words must be as in the name."""
    small_batches(docs.sparkSession)
    levels = materialize(tree(names), "gazetteer")
    deepest = levels.agg(F.max("depth")).first()[0] or 0
    if not deepest:
        return docs.select(key, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind"), F.lit("").alias("text")).limit(0)
    words = spans(WORD.pattern, text, lower=True)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), words.alias("_w")).filter(F.size("_w") > 0)
    # Each place has the words that a name could have from there on; texts come back by the key.
    windows = F.transform(F.col("_w"), lambda w, i: F.struct(w["start"].alias("start"), F.slice(F.col("_w"), i + 1, deepest).alias("ahead")))
    places = rows.select("_key", F.inline(windows)).withColumn("prefix", F.get("ahead", F.lit(0))["text"])
    found = None
    for depth in range(1, deepest + 1):
        level = levels.filter(F.col("depth") == depth).select("prefix", "ends")
        places = places.join(small(level), "prefix")
        hits = places.filter(F.size("ends") > 0).select("_key", "start", F.get("ahead", F.lit(depth - 1))["end"].alias("end"), F.explode("ends").alias("name"))
        found = hits if found is None else found.unionByName(hits)
        places = places.drop("ends").filter(F.size("ahead") > depth).withColumn("prefix", F.concat("prefix", F.lit(" "), F.get("ahead", F.lit(depth))["text"]))
    said = found.join(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key").withColumn("text", F.expr("substring(_text, start + 1, end - start)"))
    said = said.filter(F.lower("text") == F.col("name.name")).select("_key", "start", "end", "name.kind", "text")
    longest = said.groupBy("_key", "start").agg(F.max_by(F.struct("end", "kind", "text"), "end").alias("s")).select("_key", "start", "s.*")
    return leftmost(longest, "_key").withColumnRenamed("_key", key)


def leftmost(found: DataFrame, key: str) -> DataFrame:
    """Of overlapping spans (key, start, end, kind, text), one at a start, those that a reader from the left takes."""
    before = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = found.withColumn("_new", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(along))
    span = F.struct("start", "end", "kind", "text")
    held = runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list(span)).alias("_s"))
    none = F.array().cast("array<struct<start: int, end: int, kind: string, text: string>>")
    taken = F.aggregate(F.col("_s"), none, lambda a, s: F.when((F.size(a) == 0) | (s["start"] >= F.element_at(a, -1)["end"]), F.concat(a, F.array(s))).otherwise(a))
    return held.select(key, F.inline(F.when(F.size("_s") == 1, F.col("_s")).otherwise(taken)))


def outermost(found: DataFrame, key: str) -> DataFrame:
    """Spans that lie in no longer one, by one running maximum; of equal spans the smallest kind stays."""
    found = found.groupBy(key, "start", "end").agg(F.min(F.struct("kind", "text")).alias("s")).select(key, "start", "end", "s.*")
    before = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_most", F.max("end").over(before)).filter(F.col("_most").isNull() | (F.col("end") > F.col("_most"))).drop("_most")
