"""Graph operators over edges (from_id, to_id, rel, weight) and uri edges.

Loops run on the driver, a round at a time; each round's frontier or scores are
written to the shared folder, so lineage stays short and lost executors cost one
round. Bounds on depth or rounds are parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.operators.ordering import with_positions
from recollex.session import small_batches
from recollex.storage import Scratch, materialize, small

CAUSAL = ("caused", "derived_from", "depends_on")


def relate(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (from, to, rel); of several new rows the last by ``seq`` counts."""
    both = edges.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.select("from_id", "to_id", "rel", "weight", F.col("seq").cast("long")))
    return both.groupBy("from_id", "to_id", "rel").agg(F.max_by("weight", "seq").alias("weight"))


def upsert_nodes(sightings: DataFrame) -> DataFrame:
    """(uri, kind, title, first_seen, last_seen) of all sightings (uri, kind, title, ts)."""
    order = F.col("ts")
    return sightings.groupBy("uri").agg(
        F.min_by("kind", order).alias("kind"), F.max_by("title", F.when(F.col("title").isNotNull(), order)).alias("title"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


def neighbors(edges: DataFrame, node: int, top: int, *, rel: str | None = None) -> DataFrame:
    rows = edges.filter(F.col("from_id") == node)
    if rel is not None:
        rows = rows.filter(F.col("rel") == rel)
    return rows.select("to_id", "rel", "weight").orderBy(F.desc("weight"), "to_id").limit(top)


def capped(edges: DataFrame, cap: int, *, src: str = "from_id", dst: str = "to_id") -> DataFrame:
    """The heaviest ``cap`` edges of each node, ties to the smaller target."""
    order = Window.partitionBy(src).orderBy(F.desc("weight"), dst, "rel")
    return edges.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap).drop("_r")


def hops(edges: DataFrame, seeds: DataFrame, max_hops: int, *, cap: int | None = None) -> DataFrame:
    """(id, hop): fewest edges from a seed (id), up to ``max_hops``; seeds are at 0."""
    scratch = Scratch(edges.sparkSession, "hops")
    steps = (capped(edges, cap) if cap else edges).select("from_id", "to_id").distinct()
    seen = scratch.write(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "seen0")
    for hop in range(1, max_hops + 1):
        front = seen.filter(F.col("hop") == hop - 1)
        new = front.join(steps, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id")).distinct().join(seen, "id", "left_anti")
        if new.isEmpty():
            break
        seen = scratch.write(seen.unionByName(new.withColumn("hop", F.lit(hop))), f"seen{hop}")
        scratch.drop(f"seen{hop - 1}")
    return seen


def traverse(edges: DataFrame, start: int, max_depth: int, top: int, decay: float, *, rel: str | None = None) -> DataFrame:
    """(id, depth, score, rels): breadth-first; a node keeps the best of the paths that reach it first.

    The score of a node is its parent's times the weight times decay ** depth.
    """
    scratch = Scratch(edges.sparkSession, "traverse")
    steps = capped(edges if rel is None else edges.filter(F.col("rel") == rel), top)
    root = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(0).alias("depth"), F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("rels"))
    seen = scratch.write(root, "seen0")
    for depth in range(1, max_depth + 1):
        front = seen.filter(F.col("depth") == depth - 1)
        found = front.join(steps, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id"), F.lit(depth).alias("depth"), (F.col("score") * F.col("weight") * decay**depth).alias("score"), F.concat("rels", F.array("rel")).alias("rels"))
        new = found.groupBy("id").agg(F.max(F.struct("score", "depth", "rels")).alias("b")).select("id", "b.depth", "b.score", "b.rels").join(seen.select("id"), "id", "left_anti")
        if new.isEmpty():
            break
        seen = scratch.write(seen.unionByName(new), f"seen{depth}")
        scratch.drop(f"seen{depth - 1}")
    return seen.filter("depth > 0")


def _walk(steps: DataFrame, uri: str, max_depth: int) -> DataFrame:
    """(uri, depth) of what (here, there) steps reach from ``uri``: each uri once, at its least depth, below ``max_depth``."""
    scratch = Scratch(steps.sparkSession, "walk")
    steps = scratch.write(steps.distinct(), "steps")
    known = steps.select(F.col("here").alias("uri")).union(steps.select("there")).filter(F.col("uri") == uri)
    seen = scratch.write(known.distinct().withColumn("depth", F.lit(0)).filter(F.lit(max_depth) > 0), "seen0")
    for depth in range(1, max_depth):
        front = seen.filter(F.col("depth") == depth - 1).select(F.col("uri").alias("here"))
        new = front.join(steps, "here").select(F.col("there").alias("uri")).distinct().join(seen.select("uri"), "uri", "left_anti")
        after = scratch.write(seen.unionByName(new.withColumn("depth", F.lit(depth))), f"seen{depth}")
        scratch.drop(f"seen{depth - 1}")
        seen = after
        if seen.filter(F.col("depth") == depth).isEmpty():
            break
    return seen.orderBy("depth", "uri")


def why(edges: DataFrame, uri: str, max_depth: int, rels: tuple[str, ...] = CAUSAL) -> DataFrame:
    """(uri, depth): what led to ``uri``, against causal edges; depth stays below ``max_depth``. Unknown uris give nothing.

    A frontier a round, without those seen before; so the work is that of the
    edges reached, however many paths there are.
    """
    causal = edges.filter(F.col("rel").isin(*rels))
    known = edges.select(F.col("from_uri").alias("u")).union(edges.select("to_uri")).filter(F.col("u") == uri).limit(1)
    alone = known.select(F.col("u").alias("here"), F.col("u").alias("there"))  # a known uri without causal edges is its own answer
    return _walk(causal.select(F.col("to_uri").alias("here"), F.col("from_uri").alias("there")).unionByName(alone), uri, max_depth)


def expand(edges: DataFrame, uri: str, max_depth: int) -> DataFrame:
    """(uri, depth): what ``uri`` leads to, along all edges."""
    return _walk(edges.select(F.col("from_uri").alias("here"), F.col("to_uri").alias("there")), uri, max_depth)


def dot(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(text,): the subgraph among reached uris in the DOT language; reached by a bounded walk, so it is small."""
    keep = reached.select("uri")
    rows = edges.join(keep.withColumnRenamed("uri", "from_uri"), "from_uri").join(keep.withColumnRenamed("uri", "to_uri"), "to_uri").select("from_uri", "to_uri", "rel").distinct()
    line = F.format_string('  "%s" -> "%s" [label="%s"];', "from_uri", "to_uri", "rel")
    return rows.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body")).select(F.concat(F.lit("digraph g {\n"), "body", F.lit("\n}")).alias("text"))


def shortest_path(edges: DataFrame, source: int, target: int, max_depth: int) -> DataFrame:
    """(cost, path): cheapest path of at most ``max_depth`` edges, an edge costing max(0, 1 - weight); no row if there is none.

    Keeps the cheapest way to each node for each number of edges, a round an edge.
    """
    scratch = Scratch(edges.sparkSession, "path")
    steps = edges.groupBy("from_id", "to_id").agg(F.min(F.greatest(1 - F.col("weight"), F.lit(0.0))).alias("step"))
    start = edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0.0).alias("cost"), F.array(F.lit(source).cast("long")).alias("path"))
    front = best = scratch.write(start, "front0")
    for depth in range(1, max_depth + 1):
        found = front.join(steps, F.col("id") == F.col("from_id")).filter(~F.array_contains("path", F.col("to_id"))).select(F.col("to_id").alias("id"), (F.col("cost") + F.col("step")).alias("cost"), F.concat("path", F.array("to_id")).alias("path"))
        front = scratch.write(found.groupBy("id").agg(F.min(F.struct("cost", "path")).alias("b")).select("id", "b.cost", "b.path"), f"front{depth}")
        if front.isEmpty():
            break
        best = best.unionByName(front)
    return best.filter(F.col("id") == target).agg(F.min(F.struct(F.round("cost", 12).alias("cost"), "path")).alias("b")).filter("b is not null").select("b.cost", "b.path")


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, *, tolerance: float | None = None) -> DataFrame:
    """(id, score): weighted PageRank; what nodes without edges hold is shared among all."""
    scratch = Scratch(edges.sparkSession, "pagerank")
    nodes = scratch.write(edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    flow = edges.groupBy("from_id", "to_id").agg(F.sum("weight").alias("w"))
    out = flow.groupBy("from_id").agg(F.sum("w").alias("total")).filter("total > 0")
    flow = scratch.write(flow.join(out, "from_id").select("from_id", "to_id", (F.col("w") / F.col("total")).alias("share")), "flow")
    sources = flow.select(F.col("from_id").alias("id")).distinct()
    rank = scratch.write(nodes.withColumn("score", F.lit(1.0 / n)), "rank0")
    for number in range(1, rounds + 1):
        loose = rank.join(sources, "id", "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        came = rank.join(flow, F.col("id") == F.col("from_id")).groupBy(F.col("to_id").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("came"))
        base = (1 - damping) / n + damping * loose / n
        after = scratch.write(nodes.join(came, "id", "left").select("id", (F.lit(base) + damping * F.coalesce("came", F.lit(0.0))).alias("score")), f"rank{number}")
        if tolerance is not None:
            moved = after.join(rank.withColumnRenamed("score", "old"), "id").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        scratch.drop(f"rank{number - 1}")
        rank = after
        if tolerance is not None and moved < tolerance:
            break
    return rank


def personalized_pagerank(edges: DataFrame | Callable[[DataFrame], DataFrame], seeds: DataFrame, alpha: float = 0.15, rounds: int = 10, *, least: float = 1e-9) -> DataFrame:
    """(id, score): walks that return to the seeds (id, score) with chance alpha, and from nodes without edges.

    All edges of a node count; scores below ``least`` aren't handed on.

    ``edges`` may be a function from nodes (id) to the edges (from_id, to_id,
    weight, one of a pair) that leave them; it is asked for each node once, when
    a walk comes there.
    """
    scratch = Scratch(seeds.sparkSession, "ppr")
    total = seeds.agg(F.sum("score")).first()[0]
    if not total:
        return seeds.select("id", F.col("score").cast("double").alias("score")).limit(0)
    start = scratch.write(seeds.groupBy("id").agg((F.sum("score") / total).alias("home")), "seeds")
    if callable(edges):
        flow, known = None, None
    else:
        flow = scratch.write(_shares(edges.groupBy("from_id", "to_id").agg(F.sum("weight").alias("weight"))), "flow")
    rank = scratch.write(start.select("id", F.col("home").alias("score")), "rank0")
    for number in range(1, rounds + 1):
        live = rank.filter(F.col("score") >= least)
        if callable(edges):
            new = live.select("id") if known is None else live.select("id").join(known, "id", "left_anti")
            new = scratch.write(new, f"asked{number}")
            known = new if known is None else known.unionByName(new)
            part = scratch.write(_shares(edges(new)), f"flow{number}")
            flow = part if flow is None else flow.unionByName(part)
        sources = flow.select(F.col("from_id").alias("id")).distinct()
        loose = live.join(sources, "id", "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        came = live.join(flow, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id"), ((1 - alpha) * F.col("score") * F.col("share")).alias("score"))
        home = start.select("id", ((alpha + (1 - alpha) * loose) * F.col("home")).alias("score"))
        rank = scratch.write(came.unionByName(home).groupBy("id").agg(F.sum("score").alias("score")), f"rank{number}")
        scratch.drop(f"rank{number - 1}")
    return rank


def _shares(edges: DataFrame) -> DataFrame:
    """(from_id, to_id, share): the edges of each node, by their parts of its weight."""
    whole = Window.partitionBy("from_id")
    return edges.select("from_id", "to_id", (F.col("weight") / F.sum("weight").over(whole)).alias("share"))


def communities(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, label, settled): synchronous label propagation over both directions; most weight wins, ties to the smaller label.

    All nodes change at once, so results don't depend on any order; a node counts
    its own label with weight just below its lightest edge, which stops flicker. It
    ends when no label changes, when the labels are those of an earlier round (they
    then go round in a circle for ever), or after ``rounds``, if given; ``settled``
    tells whether the last round left a node's label as it was.
    """
    scratch = Scratch(edges.sparkSession, "labels")
    both = edges.select("from_id", "to_id", "weight").unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "weight"))
    both = scratch.write(both.filter("from_id <> to_id").groupBy("from_id", "to_id").agg(F.sum("weight").alias("weight")), "edges")
    own = both.groupBy("from_id").agg((F.min("weight") * 0.999).alias("weight"))
    both = both.unionByName(own.select("from_id", F.col("from_id").alias("to_id"), "weight"))
    labels = scratch.write(both.select(F.col("from_id").alias("id")).distinct().withColumn("label", F.col("id")), "labels0")
    settled, met = labels.withColumn("settled", F.lit(rounds is None)), set()
    for number in count(1) if rounds is None else range(1, rounds + 1):
        votes = both.join(labels, F.col("to_id") == F.col("id")).groupBy("from_id", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        best = votes.groupBy("from_id").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("b")).select(F.col("from_id").alias("id"), (-F.col("b.l")).alias("label"))
        after = scratch.write(best, f"labels{number}")
        same = (F.col("label") == F.col("old")).alias("settled")
        settled = scratch.write(after.join(labels.withColumnRenamed("label", "old"), "id").select("id", "label", same), f"settled{number}")
        changed, state = settled.agg(F.coalesce(F.sum((~F.col("settled")).cast("int")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("id", "label").cast("decimal(38,0)")), F.lit(0))).first()
        scratch.drop(f"labels{number - 1}", f"settled{number - 1}")
        labels = after
        if not changed or state in met:
            break
        met.add(state)
    return settled


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id that can be reached in either direction, by least labels and shortcuts, until none changes."""
    scratch = Scratch(edges.sparkSession, "parts")
    both = edges.select("from_id", "to_id").union(edges.select("to_id", "from_id")).distinct()
    both = scratch.write(both, "edges")
    labels = scratch.write(both.groupBy(F.col("from_id").alias("id")).agg(F.least(F.min("to_id"), F.first("from_id")).alias("component")), "labels0")
    for number in count(1):  # a label only ever shrinks, so this ends
        near = both.join(labels, F.col("to_id") == F.col("id")).groupBy(F.col("from_id").alias("id")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        after = labels.join(near, "id", "left").join(jump, "component", "left").select("id", F.least("component", F.coalesce("near", "component"), F.coalesce("far", "component")).alias("component"))
        after = scratch.write(after, f"labels{number}")
        same = after.join(labels.withColumnRenamed("component", "old"), "id").filter("component <> old").isEmpty()
        scratch.drop(f"labels{number - 1}")
        labels = after
        if same:
            break
    return labels


def supersession(edges: DataFrame) -> DataFrame:
    """(id, current): the end of each chain of replacements (from_id -> to_id), of any length.

    One replaced several times counts as replaced by the greatest id. A chain that
    runs into a circle stops before it would come to an id again. Chains are
    followed by doubling: a round joins each place with what lies as far ahead
    again, so rounds grow with the logarithm of the number of chains' links. Chains
    that never come to an end stand on their circle after so many steps; they are
    doubled again up to its first member, and end at the member before that.
    """
    scratch = Scratch(edges.sparkSession, "chains")
    steps = scratch.write(edges.filter("from_id is not null and to_id is not null").groupBy(F.col("from_id").alias("id")).agg(F.max("to_id").alias("next")), "steps")
    n = steps.count()
    # ahead: where each id is after 2 ** round steps, staying at an end.
    ahead = scratch.write(steps.select("id", F.col("next").alias("at")), "ahead0")
    rounds = max(n, 1).bit_length()
    for number in range(1, rounds + 1):
        more = ahead.select(F.col("id").alias("at"), F.col("at").alias("far"))
        ahead = scratch.write(ahead.join(more, "at", "left").select("id", F.coalesce("far", "at").alias("at")), f"ahead{number}")
        scratch.drop(f"ahead{number - 1}")
    # Whoever is still on a step after more steps than there are is on a circle, and so is where it stands.
    lost = ahead.join(steps.select(F.col("id").alias("at")), "at", "left_semi")
    ended = ahead.join(steps.select(F.col("id").alias("at")), "at", "left_anti").select("id", F.col("at").alias("current"))
    if lost.isEmpty():
        return ended
    ring = scratch.write(lost.select(F.col("at").alias("id")).distinct(), "ring")
    before = steps.join(ring, "id", "left_semi").select(F.col("next").alias("entry"), F.col("id").alias("current"))
    # Where each lost chain enters its circle: doubled again, now staying at the first member.
    own = steps.join(lost.select("id"), "id", "left_semi").join(ring.withColumn("member", F.lit(True)), "id", "left")
    entry = scratch.write(own.select("id", F.when(F.col("member"), F.col("id")).otherwise(F.col("next")).alias("entry")), "entry0")
    for number in range(1, rounds + 1):
        far = entry.select(F.col("id").alias("entry"), F.col("entry").alias("far"))
        entry = scratch.write(entry.join(far, "entry").select("id", F.col("far").alias("entry")), f"entry{number}")
        scratch.drop(f"entry{number - 1}")
    return ended.unionByName(entry.join(before, "entry").select("id", "current"))


#: Bytes of other entities' numbers that a task of ``entity_graph`` sorts; pairs that one step in a Python worker sums; bytes of names sent to all tasks.
PARTNER_BYTES, PAIRS, BROADCAST_NAMES = 32 << 20, 1 << 20, 128 << 20


def entity_graph(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(from_entity, to_entity, weight): entities that share a document, in both directions, each document giving 1 / sqrt(its entities).

    Entities are numbered, rare ones first. An entity gets, from each of its
    documents, the numbers of the more frequent ones as one list, so a pair is met
    once, four bytes of it are moved, and no entity meets more than its own
    documents hold. Lists come sorted by entity and are summed a step at a time.
    """
    from recollex.functions.text import entities

    small_batches(docs.sparkSession)
    rows = docs.filter("id is not null").select("id", F.explode(entities(F.col(text))).alias("entity"))
    rows = materialize(rows, "mentions")
    names = with_positions(rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "n", "entity", position="no").select(F.col("no").cast("int").alias("no"), "entity")
    names = materialize(names, "names")
    if names.agg(F.coalesce(F.sum(F.octet_length("entity") + 32), F.lit(0))).first()[0] <= BROADCAST_NAMES:
        names = F.broadcast(names)  # of a counted size
    lists = rows.join(names, "entity").groupBy("id").agg(F.sort_array(F.collect_set("no")).alias("held")).select("held", F.size("held").alias("n"))
    lists = materialize(lists.filter("n > 1"), "lists")
    moved = lists.agg(F.coalesce(F.sum(F.col("n").cast("long") * (F.col("n") - 1) * 2), F.lit(0))).first()[0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(moved) // PARTNER_BYTES))
    each = lists.select("n", "held", F.posexplode("held").alias("i", "a")).filter("i < n - 1").select("a", "n", F.expr("slice(held, i + 2, n)").alias("more"))
    pairs = each.repartition(tasks, "a").sortWithinPartitions("a").mapInArrow(_summed_pairs, "a int, b int, weight double")
    named = pairs.join(names.select(F.col("no").alias("a"), F.col("entity").alias("x")), "a").join(names.select(F.col("no").alias("b"), F.col("entity").alias("y")), "b")
    ways = F.array(F.struct(F.col("x").alias("from_entity"), F.col("y").alias("to_entity"), "weight"), F.struct(F.col("y").alias("from_entity"), F.col("x").alias("to_entity"), "weight"))
    return named.select(F.inline(ways))


def _summed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of 1 / sqrt(n) for pairs of rows (a, n, more), which come sorted by a; what the last a has is kept until a greater one comes."""
    keys, sums = [np.empty(0, np.int64)], [np.empty(0)]

    def step(last: bool) -> Iterator[pa.RecordBatch]:
        key, w = np.concatenate(keys), np.concatenate(sums)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, w = key[first], np.add.reduceat(w[order], first) if len(first) else w
        done = len(key) if last else int(np.searchsorted(key, key[-1] >> 32 << 32)) if len(key) else 0
        keys[:], sums[:] = [key[done:]], [w[done:]]
        for at in range(0, done, PAIRS):
            part = slice(at, min(at + PAIRS, done))
            yield pa.RecordBatch.from_arrays([pa.array((key[part] >> 32).astype(np.int32)), pa.array((key[part] & 0xFFFFFFFF).astype(np.int32)), pa.array(w[part])], ["a", "b", "weight"])

    held = 0
    for batch in batches:
        more = batch.column("more")
        sizes = np.diff(more.offsets.to_numpy())
        a, n = batch.column("a").to_numpy().astype(np.int64), batch.column("n").to_numpy()
        keys.append(np.repeat(a << 32, sizes) | more.flatten().to_numpy())
        sums.append(np.repeat(1 / np.sqrt(n), sizes))
        held += int(sizes.sum())
        if held >= PAIRS:
            yield from step(False)
            held = 0
    yield from step(True)


def entity_rows(mentions: DataFrame) -> DataFrame:
    """(id, entities): the distinct entities of each document, as numbers (XXH64), written once; what ``edges_of`` and ``shared_walks`` read. mentions: (id, entity)."""
    return materialize(mentions.filter("id is not null").groupBy("id").agg(F.collect_set(F.xxhash64("entity")).alias("entities")), "entities")


def edges_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, to_id, weight): edges of ``entity_graph`` that leave these entities (id), from documents that have them. rows: from ``entity_rows``."""
    one = rows.select(F.explode("entities").alias("from_id"), "entities")
    front = one.join(small(nodes.select(F.col("id").alias("from_id"))), "from_id", "left_semi")
    pairs = front.select("from_id", F.explode("entities").alias("to_id"), (1 / F.sqrt(F.size("entities"))).alias("w")).filter("from_id <> to_id")
    return pairs.groupBy("from_id", "to_id").agg(F.sum("w").alias("weight"))


#: Entities whose scores are sent to all tasks: two numbers each.
BROADCAST_SCORES = 2_000_000


def shared_walks(rows: DataFrame, seeds: DataFrame, alpha: float = 0.15, rounds: int = 10) -> DataFrame:
    """(id, score): ``personalized_pagerank`` over all edges of ``entity_graph``, none of which is made. rows: from ``entity_rows``.

    What an entity gets through a document is what the document's other entities
    give away there, the same for all but for its own part. So a round sums what
    each document is given and hands it out again, and its work follows the
    mentions, not their pairs.
    """
    scratch = Scratch(seeds.sparkSession, "shared-walks")
    total = seeds.agg(F.sum("score")).first()[0]
    if not total:
        return seeds.select("id", F.col("score").cast("double").alias("score")).limit(0)
    start = scratch.write(seeds.groupBy("id").agg((F.sum("score") / total).alias("home")), "seeds")
    rows = rows.filter(F.size("entities") > 1)
    each = rows.select(F.explode("entities").alias("id"), ((F.size("entities") - 1) / F.sqrt(F.size("entities"))).alias("w"))
    out = scratch.write(each.groupBy("id").agg(F.sum("w").alias("total")), "out")
    rank = scratch.write(start.select("id", F.col("home").alias("score")), "rank0")
    for number in range(1, rounds + 1):
        loose = rank.join(out, "id", "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        given = scratch.write(rank.filter("score > 0").join(out, "id").select("id", ((1 - alpha) * F.col("score") / F.col("total")).alias("own")), f"given{number}")
        given = small(given, BROADCAST_SCORES)
        met = rows.select(F.col("id").alias("doc"), F.explode("entities").alias("id")).join(given, "id")
        met = met.groupBy("doc").agg(F.sum("own").alias("all"), F.count(F.lit(1)).alias("givers"))
        handed = rows.withColumnRenamed("id", "doc").join(small(scratch.write(met, f"met{number}"), BROADCAST_SCORES), "doc")
        handed = handed.select(F.explode("entities").alias("id"), F.size("entities").alias("n"), "all", "givers").join(given, "id", "left")
        # The only giver of a document gets nothing there; others get all but their own part.
        handed = handed.filter(F.col("own").isNull() | (F.col("givers") > 1))
        came = handed.select("id", ((F.col("all") - F.coalesce("own", F.lit(0.0))) / F.sqrt("n")).alias("score"))
        home = start.select("id", ((alpha + (1 - alpha) * loose) * F.col("home")).alias("score"))
        rank = scratch.write(came.unionByName(home).groupBy("id").agg(F.sum("score").alias("score")), f"rank{number}")
        scratch.drop(f"rank{number - 1}", f"given{number}", f"met{number}")
    return rank


def to_json(rows: DataFrame, *columns: str) -> DataFrame:
    """(json,): all rows as one JSON list in the order of the columns; for results of a bounded size."""
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("json"))


def like_entities(entities: DataFrame, terms: Column | list[str], most: int | None = 10) -> DataFrame:
    """(term, name): entities whose name holds a term, at most ``most`` a term if given, shortest names first."""
    asked = entities.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("term"))
    pairs = entities.crossJoin(F.broadcast(asked)).filter(F.contains(F.lower("name"), F.lower("term")))  # a few terms of one query
    if most is None:
        return pairs.select("term", "name")
    order = Window.partitionBy("term").orderBy(F.length("name"), "name")
    return pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("term", "name")
