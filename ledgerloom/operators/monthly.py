"""Calendar-month statistics of a ledger.

Every statistic but the percentile reads ledger rows or their ``rollup``, so a composed
report aggregates the ledger once. Rollups of different days can be put together by a
union: a new month is added without reading the old ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import values
from ledgerloom.operators.quantiles import exact_quantiles


# Columns of a rollup beside its keys.
SPENT, PRICED, ROWS, LARGEST = "_spent", "_priced", "_rows", "_largest"


def rollup(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spend, number of amounts, rows and largest amount per month, date, vendor and category."""
    dated = with_month(_with_category(df)).where(F.col("month").isNotNull())
    return dated.groupBy(*keys, "month", "date", "vendor", "category").agg(
        values.total(F.col("amount")).alias(SPENT),
        F.count("amount").alias(PRICED),
        F.count(F.lit(1)).alias(ROWS),
        F.max("amount").alias(LARGEST),
    )


def spent(df: DataFrame) -> Column:
    """Sum of money over ledger rows or rows of a rollup, as a decimal."""
    return F.sum(SPENT) if SPENT in df.columns else values.total(F.col("amount"))


def priced(df: DataFrame) -> Column:
    """Number of amounts."""
    return F.sum(PRICED) if PRICED in df.columns else F.count("amount")


def row_count(df: DataFrame) -> Column:
    return F.sum(ROWS) if ROWS in df.columns else F.count(F.lit(1))


def largest(df: DataFrame) -> Column:
    return F.max(LARGEST) if LARGEST in df.columns else F.max("amount")


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", values.month_start(F.col("date")))


def monthly_stats(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total, count, mean, distinct vendors and date range per month.

    Months and vendors are aggregated first, so the distinct count is a plain
    count over the much smaller month-vendor table.
    """
    per_vendor = with_month(df).where(F.col("month").isNotNull()).groupBy(*keys, "month", "vendor").agg(
        spent(df).alias("_t"),
        priced(df).alias("_n"),
        row_count(df).alias("_all"),
        F.min("date").alias("_first"),
        F.max("date").alias("_last"),
    )
    out = per_vendor.groupBy(*keys, "month").agg(
        F.sum("_t").alias("_total"),
        F.sum("_n").alias("_n"),
        F.sum("_all").alias("transaction_count"),
        F.count("vendor").alias("unique_vendors"),
        F.min("_first").alias("first_date"),
        F.max("_last").alias("last_date"),
    )
    total = F.col("_total").cast("double")
    return out.select(
        *keys,
        "month",
        total.alias("total_amount"),
        "transaction_count",
        (total / F.nullif(F.col("_n"), F.lit(0))).alias("average_amount"),
        "unique_vendors",
        "first_date",
        "last_date",
    )


def month_category(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _month_totals(df, keys, "category")


def month_vendor(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _month_totals(df, keys, "vendor")


def month_top_category(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Largest category of each month, ``Unknown`` when no row has one."""
    pairs = (
        with_month(_with_category(df))
        .where(F.col("month").isNotNull())
        .groupBy(*keys, "month", "category")
        .agg(spent(df).alias("_t"))
    )
    order = F.when(
        F.col("category").isNotNull(), F.struct((-F.col("_t")).alias("t"), F.col("category").alias("c"))
    )
    best = F.coalesce(F.min_by("category", order), F.lit("Unknown"))
    return pairs.groupBy(*keys, "month").agg(best.alias("top_category"))


def month_top_vendors(df: DataFrame, n: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` vendors with the highest spend of each month."""
    w = Window.partitionBy(*keys, "month").orderBy(F.desc("total_amount"), "vendor")
    ranked = month_vendor(df, keys).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= n)


def month_frequent_vendors(df: DataFrame, n: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` vendors with the most transactions of each month."""
    counts = (
        with_month(df)
        .where(F.col("vendor").isNotNull() & F.col("month").isNotNull())
        .groupBy(*keys, "month", "vendor")
        .agg(row_count(df).alias("transaction_count"))
    )
    w = Window.partitionBy(*keys, "month").orderBy(F.desc("transaction_count"), "vendor")
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= n)


def month_p95(df: DataFrame, q: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    monthly = with_month(df).where(F.col("month").isNotNull())
    return exact_quantiles(monthly, [*keys, "month"], "amount", {"p95": q})


def month_large_txns(df: DataFrame, q: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    """Rows above their month's 95th percentile, with that percentile."""
    cut = month_p95(df, q, keys)
    return with_month(df).join(cut, [*keys, "month"]).where(F.col("amount") > F.col("p95"))


def month_daily(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spend per day of month."""
    days = with_month(df).where(F.col("month").isNotNull())
    return (
        days.groupBy(*keys, "month", F.dayofmonth("date").alias("day"))
        .agg(spent(df).alias("_t"))
        .select(*keys, "month", "day", values.as_double(F.col("_t")).alias("total_amount"))
    )


def _with_category(df: DataFrame) -> DataFrame:
    return df if "category" in df.columns else df.withColumn("category", F.lit(None).cast("string"))


def _month_totals(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    source = _with_category(df) if name == "category" else df
    return (
        with_month(source)
        .where(F.col(name).isNotNull() & F.col("month").isNotNull())
        .groupBy(*keys, "month", name)
        .agg(spent(df).alias("_t"))
        .select(*keys, "month", name, values.as_double(F.col("_t")).alias("total_amount"))
    )
