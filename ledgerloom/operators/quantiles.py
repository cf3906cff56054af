"""Exact linear-interpolation quantiles without one big group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    buckets: int = 1024,
) -> DataFrame:
    """One row per key with a column per requested quantile.

    The built-in ``percentile`` keeps every distinct value of a group in one
    task's memory. Here equal values are first collapsed to counts (map side),
    a fixed number of monotone buckets per key locates the order statistics
    that matter, and only the values of those buckets are put in order.
    """
    if not keys:
        one = exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, quantiles, buckets)
        return one.drop("_all")
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    span = counted.groupBy(*keys).agg(
        F.sum("_c").alias("_n"), F.min(_squash("_v")).alias("_lo"), F.max(_squash("_v")).alias("_hi")
    )
    width = F.col("_hi") - F.col("_lo")
    spot = F.when(width > 0, F.floor((_squash("_v") - F.col("_lo")) / width * F.lit(buckets - 1)))
    placed = counted.join(span, keys).select(
        *keys, "_v", "_c", "_n", F.coalesce(spot, F.lit(0)).alias("_b")
    )

    sizes = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"), F.max("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_bc").over(upto), F.lit(0)))
    wanted = [r for q in quantiles.values() for r in _ranks(q)]
    hit = F.lit(False)
    for r in wanted:
        hit = hit | ((r >= F.col("_start")) & (r < F.col("_start") + F.col("_bc")))
    kept = sizes.where(hit).select(*keys, "_b", "_start")

    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.join(kept, [*keys, "_b"]).withColumn(
        "_first", F.col("_start") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
    )

    def at(rank: Column) -> Column:
        holds = (rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_c"))
        return F.max(F.when(holds, F.col("_v")))

    picks = []
    for name, q in quantiles.items():
        low, high = _ranks(q)
        picks += [
            at(low).alias(f"_low_{name}"),
            at(high).alias(f"_high_{name}"),
            F.max(_position(q) - low).alias(f"_part_{name}"),
        ]
    found = ordered.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *(
            (
                F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")
            ).alias(n)
            for n in quantiles
        ),
    )


def _squash(name: str) -> Column:
    """Monotone map that spreads heavy-tailed amounts evenly over the buckets."""
    v = F.col(name)
    return F.signum(v) * F.log1p(F.abs(v))


def _position(q: float) -> Column:
    return (F.col("_n") - 1).cast("double") * F.lit(float(q))


def _ranks(q: float) -> tuple[Column, Column]:
    return F.floor(_position(q)), F.ceil(_position(q))
