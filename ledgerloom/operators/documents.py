"""Transactions and months rendered as searchable text with metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values
from ledgerloom.lineage import checkpoint
from ledgerloom.operators import monthly
from ledgerloom.operators.ranking import spread_row_number

# A month's document has pages of so many large transactions at every size of ledger.
LARGE_ROWS_PER_PAGE = 1000
_SLOTS = 64


def amount_text(col: Column) -> Column:
    """Shortest text with at least one decimal: ``45.0``, ``12.85``."""
    digits = F.regexp_replace(values.money(col).cast("string"), "0+$", "")
    return F.regexp_replace(digits, r"\.$", ".0")


def index_text(df: DataFrame) -> Column:
    """One line of text per ledger row, used as embedding input."""

    def part(name: str) -> Column:
        if name not in df.columns:
            return F.lit("")
        if name == "amount":
            return F.coalesce(amount_text(F.col(name)), F.lit("nan"))
        return F.coalesce(F.col(name).cast("string"), F.lit("nan"))

    # Labels of the line.
    return F.concat(
        F.lit("Date: "), part("date"), F.lit(" Amount: $"), part("amount"),
        F.lit(" Description: "), part("description"), F.lit(" Category: "), part("category"),
    )


def transaction_documents(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One document per transaction."""
    day = F.date_format("date", "yyyy-MM-dd HH:mm:ss")
    category = _default(df, "category", "Uncategorized")
    # Labels of the record.
    body = F.concat(
        F.lit("\nTRANSACTION RECORD\n\nDate: "), day,
        F.lit("\nVendor: "), F.coalesce("vendor", F.lit("nan")),
        F.lit("\nAmount: $"), values.plain_money_text(F.col("amount")),
        F.lit("\nCategory: "), category,
        F.lit("\nDescription: "), _default(df, "description", "No description"),
        F.lit("\n\nContext:\n- Day of week: "), F.date_format("date", "EEEE"),
        F.lit("\n- Month: "), F.date_format("date", "MMMM yyyy"), F.lit("\n"),
    )
    metadata = F.struct(
        F.col("txn_id").cast("string").alias("transaction_id"),
        day.alias("date"),
        F.col("vendor"),
        F.col("amount"),
        category.alias("category"),
        F.lit("transaction").alias("document_type"),
    )
    return df.select(
        *keys,
        F.concat(F.lit("txn-"), F.col("txn_id").cast("string")).alias("doc_id"),
        F.lit("transaction").alias("document_type"),
        body.alias("text"),
        metadata.alias("metadata"),
    )


def monthly_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics of each month plus its breakdowns as maps, all from one rollup.

    ``df`` holds ledger rows or their ``monthly.rollup``. A map holds one entry per category, top-10 vendor, top-5 vendor or day, so
    its size follows the number of names and never the number of rows.
    """
    group = [*keys, "month"]
    if monthly.SPENT not in df.columns:
        df = checkpoint(monthly.rollup(df, keys))
    stats = monthly.monthly_stats(df, keys)
    best = monthly.month_top_category(df, keys)
    parts = {
        "categories": _entries(monthly.month_category(df, keys), group, "category", F.col("category")),
        "vendors": _entries(monthly.month_top_vendors(df, 10, keys), group, "vendor", F.col("rank")),
        "frequent": _entries(
            monthly.month_frequent_vendors(df, 5, keys), group, "vendor", F.col("rank"), "transaction_count"
        ),
        "daily": _entries(monthly.month_daily(df, keys), group, "day", F.col("day")),
    }
    out = stats.join(best, group)
    for name, entries in parts.items():
        out = out.join(entries.withColumnRenamed("entries", name), group, "left")
    return out


def monthly_documents(
    df: DataFrame, keys: Sequence[str] = (), rows_per_page: int = LARGE_ROWS_PER_PAGE
) -> DataFrame:
    """One document per month, in pages: each lists at most ``rows_per_page`` large transactions."""
    group = [*keys, "month"]
    month = monthly_summary(df, keys)
    pages = large_pages(df, keys, rows_per_page)
    # One row per page; a month without large transactions still has its first page.
    rows = month.join(pages, group, "left").withColumn("page", F.coalesce("page", F.lit(0)))
    period = values.month_text(F.col("month"))
    # Headings of the summary.
    body = F.concat(
        F.lit("\nFINANCIAL SUMMARY FOR "), period,
        F.lit("\n\nOVERVIEW:\n- Total Spending: $"), values.money_text(F.col("total_amount")),
        F.lit("\n- Transaction Count: "), F.col("transaction_count").cast("string"),
        F.lit("\n- Average Transaction: $"), values.plain_money_text(F.col("average_amount")),
        F.lit("\n- Unique Vendors: "), F.col("unique_vendors").cast("string"),
        F.lit("\n- Date Range: "), values.day_text(F.col("first_date")),
        F.lit(" to "), values.day_text(F.col("last_date")),
        F.lit("\n\nCATEGORY BREAKDOWN:\n"), _json_block("categories"),
        F.lit("\n\nTOP VENDORS BY SPENDING:\n"), _json_block("vendors"),
        F.lit("\n\nFREQUENT VENDORS (by transaction count):\n"), _json_block("frequent", counts=True),
        F.lit("\n\nLARGE TRANSACTIONS (95th percentile):\n"), F.coalesce("lines", F.lit("")),
        F.lit("\n\nDAILY SPENDING PATTERN:\n"), _day_block("daily"), F.lit("\n"),
    )
    metadata = F.struct(
        period.alias("period"),
        F.year("month").alias("year"),
        F.month("month").alias("month"),
        F.col("total_amount"),
        F.col("transaction_count"),
        F.col("average_amount").alias("avg_transaction"),
        F.col("unique_vendors"),
        F.col("top_category"),
        F.lit("monthly_summary").alias("document_type"),
    )
    continued = F.concat(
        F.lit("\nFINANCIAL SUMMARY FOR "), period,
        F.lit("\n\nLARGE TRANSACTIONS (95th percentile), continued:\n"), F.col("lines"), F.lit("\n"),
    )
    number = F.when(F.col("page") > 0, F.col("page").cast("string"))
    return rows.select(
        *keys,
        F.concat_ws("-", F.lit("month"), period, number).alias("doc_id"),
        F.lit("monthly_summary").alias("document_type"),
        F.when(F.col("page") == 0, body).otherwise(continued).alias("text"),
        metadata.alias("metadata"),
    )


def large_pages(df: DataFrame, keys: Sequence[str], rows_per_page: int) -> DataFrame:
    """Large transactions of each month as text lines, at most ``rows_per_page`` per page."""
    group = [*keys, "month"]
    large = monthly.month_large_txns(df, keys=keys)
    # Slots hold about equally many rows, however the ids are spread.
    marks = large.agg(F.percentile_approx("txn_id", [k / _SLOTS for k in range(1, _SLOTS)])).scalar()
    large = large.withColumn("_marks", marks)
    slot = F.size(F.filter("_marks", lambda m: m < F.col("txn_id")))
    ranked = spread_row_number(large, group, F.col("txn_id"), slot, "_rank")
    line = F.concat_ws(
        " ",
        values.day_text(F.col("date")),
        "vendor",
        amount_text(F.col("amount")),
        F.coalesce(_default(df, "category", "nan"), F.lit("nan")),
    )
    paged = ranked.select(
        *group, F.floor((F.col("_rank") - 1) / rows_per_page).alias("page"),
        F.struct(F.col("_rank").alias("r"), line.alias("t")).alias("s"),
    )
    return paged.groupBy(*group, "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n").alias("lines")
    )


def ledger_documents(
    df: DataFrame, include_transactions: bool = False, keys: Sequence[str] = ()
) -> DataFrame:
    """Monthly documents, optionally with one document per transaction."""
    months = monthly_documents(df, keys).withColumn("metadata", F.to_json("metadata"))
    if not include_transactions:
        return months
    txns = transaction_documents(df, keys).withColumn("metadata", F.to_json("metadata"))
    return months.unionByName(txns, allowMissingColumns=True)


def index_stats(df: DataFrame, include_transactions: bool = False, rows_per_page: int = LARGE_ROWS_PER_PAGE) -> DataFrame:
    """Document count, ledger rows and date range in one row; nothing is rendered.

    Counts the documents ``ledger_documents`` has: the pages of every month, at least
    one, and the transactions where they are included.
    """
    months = monthly.with_month(df).where("month IS NOT NULL").groupBy("month").agg(F.count(F.lit(1)).alias("_rows"))
    large = monthly.month_large_txns(df).groupBy("month").agg(F.count(F.lit(1)).alias("_large"))
    pages = months.join(large, "month", "left").agg(
        F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(F.coalesce("_large", F.lit(0)) / rows_per_page))), F.lit(0)).alias("_pages")
    )
    count = pages.scalar()
    if include_transactions:
        count = count + F.col("data_rows")
    return df.agg(
        F.count(F.lit(1)).alias("data_rows"),
        values.day_text(F.min("date")).alias("start"),
        values.day_text(F.max("date")).alias("end"),
    ).select(F.lit("Index ready").alias("status"), count.cast("long").alias("document_count"), "data_rows", "start", "end")


def _default(df: DataFrame, name: str, default: str) -> Column:
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name), F.lit(default))


def _entries(
    rows: DataFrame, group: list[str], name: str, order: Column, value: str = "total_amount"
) -> DataFrame:
    entry = F.struct(order.alias("o"), F.col(name).cast("string").alias("key"), F.col(value).alias("value"))
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def _json_block(name: str, counts: bool = False) -> Column:
    """A JSON object with one indented line per entry."""

    def show(e: Column) -> Column:
        shown = e["value"].cast("string") if counts else amount_text(e["value"])
        return F.concat(F.lit("  "), _quoted(e["key"]), F.lit(": "), shown)

    lines = F.array_join(F.transform(F.col(name), show), ",\n")
    return F.when(F.size(F.coalesce(F.col(name), F.expr("array()"))) > 0, F.concat(F.lit("{\n"), lines, F.lit("\n}"))).otherwise("{}")


def _quoted(col: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(col)), r"^\[|\]$", "")


def _day_block(name: str) -> Column:
    pairs = F.transform(F.col(name), lambda e: F.concat(e["key"], F.lit(": "), amount_text(e["value"])))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(pairs, ", "), F.lit("")), F.lit("}"))
