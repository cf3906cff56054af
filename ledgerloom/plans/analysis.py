"""The three ledger analyses as one call each: whole ledger, categories, vendors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values
from ledgerloom.operators import clean, summary


@dataclass
class LedgerAnalysis:
    """Usable transactions of a raw ledger; every other part is a plan over them."""

    transactions: DataFrame

    @property
    def summary(self) -> DataFrame:
        return summary.ledger_summary(self.transactions)

    @property
    def report(self) -> DataFrame:
        return summary.summary_text(self.transactions)

    @property
    def top_vendors(self) -> DataFrame:
        return summary.top_vendors(self.transactions, 5)

    @property
    def categories(self) -> DataFrame | None:
        if "category" not in self.transactions.columns:
            return None
        return summary.spending_by_category(self.transactions)

    @property
    def for_index(self) -> DataFrame:
        return clean.for_index(self.transactions)

    def sections(self) -> DataFrame:
        """All figures as rows: section, name, transaction_count, total_amount."""
        money = values.rounded(F.col("total_amount"), 2).alias("total_amount")
        parts = [
            self.summary.select(F.lit("ledger").alias("section"), F.lit("all").alias("name"), "transaction_count", money),
            self.top_vendors.select(F.lit("vendor").alias("section"), F.col("vendor").alias("name"), "transaction_count", money),
        ]
        if self.categories is not None:
            parts.append(
                self.categories.select(F.lit("category").alias("section"), F.col("category").alias("name"), "transaction_count", money)
            )
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def analyze_ledger(raw: DataFrame, date_formats: Sequence[str] = ()) -> LedgerAnalysis:
    """Type the columns, give every row a vendor, and keep rows with a date and an amount."""
    ready = clean.require_columns(clean.vendor_default(raw), ("date", "vendor", "amount"))
    return LedgerAnalysis(clean.drop_incomplete(clean.coerce(ready, date_formats), ("date", "amount")))


def spending_by_category(raw: DataFrame, pattern: str | None = None) -> DataFrame:
    """Total and count of every category, or of the categories that match a pattern together."""
    rows = _with_amounts(raw, ("category",))
    return summary.category_total(rows, pattern) if pattern else summary.spending_by_category(rows)


def vendor_analysis(raw: DataFrame, pattern: str | None = None) -> DataFrame:
    """Total, count and mean of every vendor, or of the vendors that match a pattern together."""
    rows = clean.drop_incomplete(_with_amounts(raw, ("vendor",)), ("vendor",))
    return summary.vendor_total(rows, pattern) if pattern else summary.vendor_stats(rows)


def _with_amounts(raw: DataFrame, needed: Sequence[str]) -> DataFrame:
    rows = clean.coerce(clean.require_columns(raw, (*needed, "amount")))
    return clean.drop_incomplete(rows, ("amount",))
