"""Validation and cleaning of ledger rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.functions import text, values
from ledgerloom.schemas import LEDGER_COLUMNS, REQUIRED_COLUMNS

# An ISO day, alone or followed by a time.
ISO_DAY_PATTERN = r"^\d{4}-\d{2}-\d{2}($|[T ]\d{2}:?\d{2})"


class LedgerError(ValueError):
    """The input cannot be used as a ledger."""


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise LedgerError("Missing required columns: " + ", ".join(missing))
    return df


def coerce(df: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    """Type the ledger columns; a value that does not parse becomes null."""
    out = df
    for name in LEDGER_COLUMNS:
        if name not in df.columns:
            continue
        raw = values.null_tokens(F.col(name).cast("string"))
        if name == "amount":
            raw = values.to_amount(raw)
        elif name == "date":
            raw = values.to_day(raw, date_formats)
        out = out.withColumn(name, raw)
    return out


def vendor_default(df: DataFrame) -> DataFrame:
    """A ledger without a vendor column takes it from the description, else ``Unknown``."""
    if "vendor" in df.columns:
        return df
    source = F.col("description") if "description" in df.columns else F.lit("Unknown")
    return df.withColumn("vendor", source)


def drop_incomplete(df: DataFrame, subset: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    return df.na.drop(subset=list(subset))


def with_rejects(df: DataFrame, subset: Sequence[str] = REQUIRED_COLUMNS):
    """Complete rows plus an ``Observation`` filled by the first action on them.

    The counters ride along with whatever job reads the rows, so counting the
    rejected rows needs no scan of its own.
    """
    seen = Observation()
    complete = _complete(subset)
    observed = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(complete).alias("rows_kept"),
        F.count_if(~complete).alias("rows_removed"),
        F.count("date").alias("valid_dates"),
    )
    return observed.where(complete), seen


def reject_count(df: DataFrame, subset: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """One row: rows read, rows kept and rows removed."""
    complete = _complete(subset)
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(complete).alias("rows_kept"),
        F.count_if(~complete).alias("rows_removed"),
        F.count("date").alias("valid_dates"),
    )


def check_usable(df: DataFrame) -> str:
    """Raise when nothing usable is left after coercion, else return the status line.

    One aggregate over the table; only four numbers reach the driver.
    """
    n = reject_count(df).first()
    if n.rows_read == 0:
        raise LedgerError("CSV file is empty")
    if n.valid_dates == 0:
        raise LedgerError("No valid dates found in date column")
    if n.rows_kept == 0:
        raise LedgerError("No valid rows found after data cleaning")
    note = f" ({n.rows_removed} invalid rows removed)" if n.rows_removed else ""
    return f"Successfully loaded {n.rows_kept} transactions{note}"


def for_index(df: DataFrame) -> DataFrame:
    """Standard columns before indexing: description is the vendor, category is never absent."""
    out = df.withColumn("description", F.col("vendor")) if "vendor" in df.columns else df
    return out if "category" in out.columns else out.withColumn("category", F.lit("Uncategorized"))


def clean_ledger(df: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    """Required columns checked, values typed, incomplete rows dropped."""
    return drop_incomplete(coerce(require_columns(df), date_formats))


def prepare_for_matching(df: DataFrame, source: str) -> DataFrame:
    """Tag the side; dates without time, amounts that do not parse are 0.0, names in match form."""
    parsed = F.coalesce(values.to_amount(F.col("amount")), F.lit(0.0))
    cleaned = {
        name: F.when(F.length(F.col(name)) > 0, text.clean_text(F.col(name))).otherwise(F.col(name))
        for name in ("vendor", "description")
        if name in df.columns
    }
    return df.withColumns(
        {
            "source": F.lit(source),
            "date": iso_day(F.col("date")),
            "amount": parsed,
            **cleaned,
        }
    )


def iso_day(col: Column) -> Column:
    """Calendar day of an ISO date or timestamp as written, whatever its zone; else null."""
    raw = F.trim(col.cast("string"))
    return F.when(raw.rlike(ISO_DAY_PATTERN), F.substring(raw, 1, 10).try_cast("date"))


def _complete(subset: Sequence[str]) -> Column:
    out = F.lit(True)
    for name in subset:
        out = out & F.col(name).isNotNull()
    return out
