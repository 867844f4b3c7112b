"""Exact order statistics of groups by mergeable sketches, without sorting a group.

A first pass builds a quantile sketch of each group (in every task, then merged) and
reads from it two values around the wanted rank. A second pass counts what lies
below, at, between and above the two, which tells for sure where the rank is: at one
of them, which is then the answer, or in a narrower bracket. Brackets with more than
``MOST`` rows are narrowed again, by a sketch of these rows alone; the values that
are left are counted by value and the one of the wanted rank is picked. A pass
shuffles a sketch or a few counts a task and group, so a group may hold all rows, and
a value any share of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.storage import Scratch, small

#: Rows within a bracket that are counted by value.
MOST = 100_000
#: A sketch's ranks are off by one in so many; and how far the two values lie from the rank, in shares of the bracket.
ACCURACY, MARGIN = 2_000, 1 / 200


def select_ranks(rows: DataFrame, groups: list[str], value: str, wanted: dict[str, Column], *, most: int = MOST) -> DataFrame:
    """(groups, n, and a column for each entry of ``wanted``): the values at these ranks.

    ``wanted`` gives ranks from 0 as expressions of ``n``, the group's number of rows
    with a value; ranks outside are null. Null and NaN values are left out; null
    groups are a group like others.
    """
    scratch = Scratch(rows.sparkSession, "selection")
    v = F.col(value)
    kept = v.isNotNull() & ~F.isnan(v) if rows.schema[value].dataType.typeName() in ("double", "float") else v.isNotNull()
    key = F.struct(*[F.col(g) for g in groups]) if groups else F.struct(F.lit(0).alias("all"))
    # Structs are equal where both have nulls.
    held = rows.filter(kept).select(key.alias("_g"), v.alias("_v"))
    kind = held.schema["_v"].dataType
    sizes = scratch.write(held.groupBy("_g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_rank")) for name, rank in wanted.items()]))
    asked = sizes.select("_g", "n", ranks.alias("_w")).select("_g", "n", "_w.*").filter((F.col("_rank") >= 0) & (F.col("_rank") < F.col("n")))
    none = F.lit(None).cast(kind)
    # A bracket's ends lie outside of it; null ends are none. ``below`` counts what lies before it.
    state = ["_g", "_name", "_rank", "_low", "_high", "_below", "_inside", "_answer"]
    at = scratch.write(asked.select("_g", "_name", "_rank", none.alias("_low"), none.alias("_high"), F.lit(0).cast("long").alias("_below"), F.col("n").alias("_inside"), none.alias("_answer")), "state0")
    number = 0
    wide = F.col("_answer").isNull() & (F.col("_inside") > most)
    while not at.filter(wide).isEmpty():
        share = (F.first("_rank") - F.first("_below")) / F.first("_inside")
        places = F.array(*[F.lit(i * MARGIN) for i in range(round(1 / MARGIN) + 1)])
        cuts = _inside(held, at.filter(wide)).groupBy("_g", "_name").agg(F.percentile_approx("_v", places, F.lit(ACCURACY)).alias("cuts"), F.floor(share / MARGIN).cast("int").alias("i"))
        ends = cuts.select("_g", "_name", F.get("cuts", F.greatest(F.col("i") - 1, F.lit(0))).alias("a"), F.get("cuts", F.least(F.col("i") + 2, F.size("cuts") - 1)).alias("b"))
        aimed = at.filter(wide).join(ends, ["_g", "_name"])
        one = lambda test: F.sum(F.when(test, 1).otherwise(0))
        x, a, b = F.col("_v"), F.col("a"), F.col("b")
        counts = _inside(held, aimed).groupBy("_g", "_name").agg(one(x < a).alias("c1"), one(x == a).alias("c2"), one((x > a) & (x < b)).alias("c3"), one((x == b) & (a < b)).alias("c4"), F.count(F.lit(1)).alias("all"))
        told = aimed.join(counts, ["_g", "_name"])
        r, upto = F.col("_rank") - F.col("_below"), [F.col("c1"), F.col("c1") + F.col("c2"), F.col("c1") + F.col("c2") + F.col("c3"), F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4")]

        def where(first, second, third, fourth, last):
            return F.when(r < upto[0], first).when(r < upto[1], second).when(r < upto[2], third).when(r < upto[3], fourth).otherwise(last)  # noqa: B023

        narrowed = told.select(
            "_g", "_name", "_rank",
            where(F.col("_low"), a, a, b, b).alias("_low"), where(a, a, b, b, F.col("_high")).alias("_high"),
            (F.col("_below") + where(F.lit(0), upto[0], upto[1], upto[2], upto[3])).alias("_below"),
            where(F.col("c1"), F.col("c2"), F.col("c3"), F.col("c4"), F.col("all") - upto[3]).alias("_inside"), where(none, a, none, b, none).alias("_answer"),
        )
        number += 1
        at = scratch.write(at.filter(~wide).select(*state).unionByName(narrowed.select(*state)), f"state{number}")
        scratch.drop(f"state{number - 1}")
    values = _inside(held, at.filter("_answer is null")).groupBy("_g", "_name", "_v").agg(F.count(F.lit(1)).alias("c"), F.first("_rank").alias("_rank"), F.first("_below").alias("_below"))
    along = Window.partitionBy("_g", "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most ``most`` values
    upto = F.col("_below") + F.sum("c").over(along)
    picked = values.withColumn("upto", upto).filter((F.col("upto") > F.col("_rank")) & (F.col("upto") - F.col("c") <= F.col("_rank"))).select("_g", "_name", F.col("_v").alias("_answer"))
    found = picked.unionByName(at.filter("_answer is not null").select("_g", "_name", "_answer"))
    found = found.groupBy("_g").agg(*[F.max(F.when(F.col("_name") == name, F.col("_answer"))).alias(name) for name in wanted])
    return sizes.join(found, "_g", "left").select(*[F.col("_g")[g].alias(g) for g in groups], "n", *wanted)


def _inside(held: DataFrame, brackets: DataFrame) -> DataFrame:
    """Rows in brackets, with what is known of these; one for each bracket of their group that they are in."""
    x = F.col("_v")
    within = (F.col("_low").isNull() | (x > F.col("_low"))) & (F.col("_high").isNull() | (x < F.col("_high")))
    return held.join(small(brackets), "_g").filter(within)
