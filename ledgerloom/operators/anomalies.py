"""Deterministic anomaly rules over monthly series.

The thresholds are parameters. Every window runs over aggregated rows (months,
category-months or vendor-months), never over raw transactions. Rules on monthly
series take ledger rows or their ``monthly.rollup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import values
from ledgerloom.lineage import checkpoint
from ledgerloom.operators import monthly
from ledgerloom.operators.quantiles import exact_quantiles

_NONE = ()


def month_over_month(df: DataFrame, threshold: float = 0.20, keys=_NONE) -> DataFrame:
    """Change against the previous calendar month; ``is_anomaly`` beyond the threshold."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("month")
    totals = _month_totals(df, keys)
    consecutive = F.add_months(F.lag("month").over(w), 1) == F.col("month")
    previous = F.when(consecutive, F.lag("total_amount").over(w))
    out = totals.withColumn("previous_amount", previous)
    change = (F.col("total_amount") - F.col("previous_amount")) / F.nullif(
        F.abs("previous_amount"), F.lit(0.0)
    )
    return out.withColumn("change", change).withColumn(
        "is_anomaly", F.coalesce(F.abs("change") > threshold, F.lit(False))
    )


def new_vendors(df: DataFrame, keys=_NONE, rolled: DataFrame | None = None) -> DataFrame:
    """Vendors seen for the first time after the ledger's first month.

    ``large`` tells whether one of the vendor's transactions in that month is
    above the month's 95th percentile, which needs the ledger's rows; all else comes
    from ``rolled`` where it is given.
    """
    source = df if rolled is None else rolled
    keys = list(keys)
    dated = monthly.with_month(source).where(F.col("month").isNotNull() & F.col("vendor").isNotNull())
    stats = dated.groupBy(*keys, "vendor", "month").agg(
        monthly.spent(source).alias("_t"),
        monthly.row_count(source).alias("transaction_count"),
        monthly.largest(source).alias("max_amount"),
    )
    first = stats.groupBy(*keys, "vendor").agg(
        F.min("month").alias("month"), F.min_by(F.struct("_t", "transaction_count", "max_amount"), "month").alias("s")
    )
    if keys:
        opening = first.join(first.groupBy(*keys).agg(F.min("month").alias("opening")), keys)
    else:
        opening = first.withColumn("opening", first.agg(F.min("month")).scalar())
    later = opening.where(F.col("month") > F.col("opening"))
    cut = monthly.month_p95(df, keys=keys)
    return later.join(cut, [*keys, "month"], "left").select(
        *keys,
        "vendor",
        "month",
        values.as_double(F.col("s._t")).alias("total_amount"),
        F.col("s.transaction_count").alias("transaction_count"),
        F.coalesce(F.col("s.max_amount") > F.col("p95"), F.lit(False)).alias("large"),
    )


def category_deviation(
    df: DataFrame, z: float = 2.0, min_months: int = 3, keys=_NONE
) -> DataFrame:
    """z-score of a category's month against all its earlier months."""
    keys = list(keys)
    w = (
        Window.partitionBy(*keys, "category")
        .orderBy("month")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = monthly.month_category(df, keys).withColumns(
        {
            "prior_months": F.count("total_amount").over(w),
            "prior_mean": F.avg("total_amount").over(w),
            "_sd": F.stddev_samp("total_amount").over(w),
        }
    )
    score = (F.col("total_amount") - F.col("prior_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    scored = out.withColumn(
        "z_score", F.when(F.col("prior_months") >= min_months, score)
    ).withColumn("is_anomaly", F.coalesce(F.abs("z_score") > z, F.lit(False)))
    return scored.drop("_sd")


def amount_outliers(df: DataFrame, spread: float = 1.5, keys=_NONE) -> DataFrame:
    """Transactions above Q3 + 1.5 IQR of their category."""
    keys = list(keys)
    group = [*keys, "category"]
    known = df.where(F.col("category").isNotNull())
    q = exact_quantiles(known, group, "amount", {"q1": 0.25, "q3": 0.75})
    fence = q.select(
        *group, (F.col("q3") + F.lit(spread) * (F.col("q3") - F.col("q1"))).alias("fence")
    )
    return known.join(fence, group).where(F.col("amount") > F.col("fence"))


def frequency_spikes(df: DataFrame, factor: float = 2.0, keys=_NONE) -> DataFrame:
    """Vendor months with more than twice the mean count of the previous three."""
    keys = list(keys)
    counts = (
        monthly.with_month(df)
        .where(F.col("vendor").isNotNull() & F.col("month").isNotNull())
        .groupBy(*keys, "vendor", "month")
        .agg(monthly.row_count(df).alias("transaction_count"))
    )
    w = Window.partitionBy(*keys, "vendor").orderBy("month").rowsBetween(-3, -1)
    out = counts.withColumns(
        {
            "_n": F.count("transaction_count").over(w),
            "prior_mean": F.avg("transaction_count").over(w),
        }
    )
    flag = (F.col("_n") == 3) & (F.col("transaction_count") > F.lit(factor) * F.col("prior_mean"))
    return out.withColumn("is_anomaly", flag).drop("_n")


def seasonal_spikes(df: DataFrame, factor: float = 2.0, keys=_NONE) -> DataFrame:
    """Months with more than twice the mean of the same calendar month in other years."""
    keys = list(keys)
    totals = _month_totals(df, keys).withColumn("calendar_month", F.month("month"))
    w = Window.partitionBy(*keys, "calendar_month")
    others = F.count("total_amount").over(w) - 1
    rest = F.sum(values.money(F.col("total_amount"))).over(w) - values.money(F.col("total_amount"))
    out = totals.withColumn(
        "other_years_mean", values.as_double(rest) / F.nullif(others, F.lit(0))
    )
    flag = F.coalesce(F.col("total_amount") > F.lit(factor) * F.col("other_years_mean"), F.lit(False))
    return out.withColumn("is_anomaly", flag)


def anomalies(df: DataFrame, keys=_NONE, rolled: DataFrame | None = None) -> DataFrame:
    """All rules in long form: rule, month, subject, measured value and its reference value.

    The monthly series come from one rollup, made here unless a kept one is given; only
    the quantiles read the ledger's rows again.
    """
    keys = list(keys)
    if rolled is None:
        rolled = checkpoint(monthly.rollup(df, keys))

    def long(rule, rows, month, subject, value, expected):
        return rows.select(
            *keys,
            F.lit(rule).alias("rule"),
            month.cast("date").alias("month"),
            subject.cast("string").alias("subject"),
            value.cast("double").alias("value"),
            expected.cast("double").alias("expected"),
        )

    c = F.col
    mom = month_over_month(rolled, keys=keys).where("is_anomaly")
    new = new_vendors(df, keys, rolled)
    dev = category_deviation(rolled, keys=keys).where("is_anomaly")
    out = amount_outliers(df, keys=keys)
    freq = frequency_spikes(rolled, keys=keys).where("is_anomaly")
    season = seasonal_spikes(rolled, keys=keys).where("is_anomaly")
    parts = [
        long("month_over_month", mom, c("month"), values.month_text(c("month")), c("total_amount"), c("previous_amount")),
        long("new_vendor", new, c("month"), c("vendor"), c("total_amount"), F.lit(None)),
        long("category_deviation", dev, c("month"), c("category"), c("total_amount"), c("prior_mean")),
        long("amount_outlier", out, values.month_start(c("date")), c("vendor"), c("amount"), c("fence")),
        long("vendor_frequency", freq, c("month"), c("vendor"), c("transaction_count"), c("prior_mean")),
        long("seasonal_spike", season, c("month"), values.month_text(c("month")), c("total_amount"), c("other_years_mean")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _month_totals(df: DataFrame, keys) -> DataFrame:
    return (
        monthly.with_month(df)
        .where(F.col("month").isNotNull())
        .groupBy(*keys, "month")
        .agg(monthly.spent(df).alias("_t"))
        .select(*keys, "month", values.as_double(F.col("_t")).alias("total_amount"))
    )
