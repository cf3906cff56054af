"""Row numbers that stay parallel inside a hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_row_number(
    df: DataFrame, keys: Sequence[str], order: Column, slot: Column, out: str
) -> DataFrame:
    """``row_number`` over ``keys`` by ``order``, computed slot by slot.

    ``slot`` must be non-decreasing in ``order``. Rows are numbered inside
    (keys, slot), and the sizes of the slots before give the offset, so one key
    with most of the rows is sorted by as many tasks as it has slots.
    """
    keys = list(keys)
    slotted = df.withColumn("_slot", slot)
    local = Window.partitionBy(*keys, "_slot").orderBy(order)
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy(*keys, "_slot")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_slot"]]
    joined = slotted.alias("l").join(offsets.alias("o"), _all(same))
    return (
        joined.select("l.*", "o._offset")
        .withColumn(out, F.row_number().over(local) + F.col("_offset"))
        .drop("_slot", "_offset")
    )


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
