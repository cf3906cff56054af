"""Ledger totals by vendor and category.

Every function takes ``keys``: extra grouping columns such as ``session_id``
that summarise many ledgers in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text, values


def ledger_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, total, mean and date range."""
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        values.total(F.col("amount")).alias("_total"),
        F.count("amount").alias("_n"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    return sums.select(
        *keys,
        "transaction_count",
        values.as_double(F.col("_total")).alias("total_amount"),
        _mean().alias("average_amount"),
        "first_date",
        "last_date",
    )


def vendor_totals(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _grouped(df, [*keys, "vendor"])


def category_totals(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _grouped(df, [*keys, "category"])


def top_vendors(df: DataFrame, n: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` most frequent vendors with count and total, from one aggregate."""
    stats = _grouped(df, [*keys, "vendor"]).select(
        *keys, "vendor", "transaction_count", values.as_double(F.col("_total")).alias("total_amount")
    )
    return top(stats, n, keys, F.desc("transaction_count"), F.asc("vendor"))


def top_categories(df: DataFrame, n: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    stats = _grouped(df, [*keys, "category"])
    best = top(stats, n, keys, F.desc("_total"), F.asc("category"))
    return best.select(*keys, "category", values.as_double(F.col("_total")).alias("total_amount"))


def category_breakdown(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total per category; rows without a category belong to none."""
    return _grouped(df, [*keys, "category"]).select(
        *keys, "category", values.as_double(F.col("_total")).alias("total_amount")
    )


def spending_by_category(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _grouped(df, [*keys, "category"]).select(
        *keys,
        "category",
        values.rounded(F.col("_total"), 2).alias("total_amount"),
        F.col("_n").alias("transaction_count"),
    )


def vendor_stats(df: DataFrame, keys: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """Total, count and mean per vendor, largest total first."""
    out = _grouped(df, [*keys, "vendor"]).select(
        *keys,
        "vendor",
        values.rounded(F.col("_total"), 2).alias("total_amount"),
        F.col("_n").alias("transaction_count"),
        values.half_up(_mean(), 2).alias("average_amount"),
    )
    return out.orderBy(*keys, F.desc("total_amount"), "vendor") if ordered else out


def category_rows(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(text.contains_pattern(F.col("category"), pattern))


def vendor_rows(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(text.contains_pattern(F.col("vendor"), pattern))


def category_detail(df: DataFrame, pattern: str) -> DataFrame:
    return category_rows(df, pattern).where("amount IS NOT NULL").select("date", "vendor", "amount", "description")


def vendor_detail(df: DataFrame, pattern: str) -> DataFrame:
    return vendor_rows(df, pattern).where("amount IS NOT NULL").select("date", "amount", "category", "description")


def category_total(df: DataFrame, pattern: str, keys: Sequence[str] = ()) -> DataFrame:
    """Total and count of the rows whose category matches; zero when none does."""
    out = category_rows(df, pattern).groupBy(*keys).agg(
        values.total(F.col("amount")).alias("_total"),
        F.count("amount").alias("transaction_count"),
    )
    return out.select(
        *keys,
        F.lit(pattern).alias("category"),
        F.coalesce(values.as_double(F.col("_total")), F.lit(0.0)).alias("total_amount"),
        "transaction_count",
    )


def vendor_total(df: DataFrame, pattern: str, keys: Sequence[str] = ()) -> DataFrame:
    """Total, count and mean of the rows whose vendor matches; no row when none does."""
    out = vendor_rows(df, pattern).groupBy(*keys).agg(
        values.total(F.col("amount")).alias("_total"), F.count("amount").alias("_n")
    )
    return out.where(F.col("_n") > 0).select(
        *keys,
        F.lit(pattern).alias("vendor"),
        values.as_double(F.col("_total")).alias("total_amount"),
        F.col("_n").alias("transaction_count"),
        _mean().alias("average_amount"),
    )


def summary_text(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The readable ledger report, one row per ledger.

    Only the top three vendors and categories reach the final text, so the
    lists that are gathered never hold more than three entries per ledger.
    """
    group = list(keys) or ["_one"]
    base = df if keys else df.withColumn("_one", F.lit(1))
    head = ledger_summary(base, group)
    bullet = "• "

    vendors = top_vendors(base, 3, group).groupBy(*group).agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct(
                            (-F.col("transaction_count")).alias("o"),
                            "vendor",
                            F.concat(
                                F.lit(bullet), "vendor", F.lit(": "),
                                F.col("transaction_count").cast("string"),
                                F.lit(" transactions ($"), values.money_text(F.col("total_amount")),
                                F.lit(")\n"),
                            ).alias("line"),
                        )
                    )
                ),
                lambda s: s["line"],
            ),
            "",
        ).alias("_vendors")
    )
    categories = None
    if "category" in df.columns:
        categories = top_categories(base, 3, group).groupBy(*group).agg(
            F.array_join(
                F.transform(
                    F.array_sort(
                        F.collect_list(
                            F.struct(
                                (-F.col("total_amount")).alias("o"),
                                "category",
                                F.concat(
                                    F.lit(bullet), "category", F.lit(": $"),
                                    values.money_text(F.col("total_amount")), F.lit("\n"),
                                ).alias("line"),
                            )
                        )
                    ),
                    lambda s: s["line"],
                ),
                "",
            ).alias("_categories")
        )

    out = head.join(vendors, group, "left")
    tail = F.lit("")
    if categories is not None:
        out = out.join(categories, group, "left")
        tail = F.concat(
            F.lit("\n\n**Top Categories:**\n"), F.coalesce(F.col("_categories"), F.lit(""))
        )
    # Headings and layout of the report.
    report = F.concat(
        F.lit("\n**\U0001F4CA Ledger Analysis:**\n\n**Summary:**\n• Total Transactions: "),
        F.format_number("transaction_count", 0),
        F.lit("\n• Total Amount: $"),
        values.money_text(F.col("total_amount")),
        F.lit("\n• Average Transaction: $"),
        values.plain_money_text(F.col("average_amount")),
        F.lit("\n• Date Range: "),
        values.day_text(F.col("first_date")),
        F.lit(" to "),
        values.day_text(F.col("last_date")),
        F.lit("\n\n**Top Vendors:**\n"),
        F.coalesce(F.col("_vendors"), F.lit("")),
        tail,
    )
    return out.select(*keys, report.alias("report"))


def top(df: DataFrame, n: int, keys: Sequence[str], *order) -> DataFrame:
    """First ``n`` rows, overall or per key; both prune before the shuffle."""
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def _grouped(df: DataFrame, group: Sequence[str]) -> DataFrame:
    present = df.where(F.col(group[-1]).isNotNull())
    return present.groupBy(*group).agg(
        values.total(F.col("amount")).alias("_total"),
        F.count("amount").alias("_n"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


def _mean():
    return values.as_double(F.col("_total")) / F.nullif(F.col("_n"), F.lit(0))
