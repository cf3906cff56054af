"""Connected components of an edge table by hooking and shortcutting, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) of every vertex in ``edges``; the root is the smallest vertex reachable.

    Every vertex points at a parent. In a round it takes the smallest grandparent among
    its neighbours, its old parent takes it too, and paths are halved. Rounds grow with
    the logarithm of the longest path. Parents only fall, so an unchanged sum ends it.
    Joins have a written table on either side, so that a hub's rows can be split.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    # Turned row by row: a union would work out the edges twice.
    turned = F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = written(ends.select(turned), "edges")
    state = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("f")), "parents")
    before = _sum(state)
    while True:
        parent = state.select(F.col("x").alias("f"), F.col("f").alias("g"))
        table = written(state.join(parent, "f").select("x", "f", "g"), "grandparents")
        nearest = both.join(table.select(F.col("x").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        offers = table.join(nearest, F.col("x") == F.col("u")).select(
            F.explode(
                F.array(
                    F.struct(F.col("x").alias("x"), F.least("f", "g", "m").alias("f")),
                    F.struct(F.col("f").alias("x"), F.col("m").alias("f")),
                )
            ).alias("o")
        )
        state = written(offers.select("o.*").groupBy("x").agg(F.min("f").alias("f")), "parents")
        after = _sum(state)
        if after == before:
            return state.select(F.col("x").alias("vertex"), F.col("f").alias("root"))
        before = after


def _sum(state: DataFrame):
    return state.agg(F.sum(F.col("f").cast("decimal(20,0)")).alias("s")).collect()[0]["s"]
