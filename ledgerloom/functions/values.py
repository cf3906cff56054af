"""Typed coercion and display formatting of amounts and dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schemas import MONEY, NULL_TOKENS

# A plain decimal number, optionally with an exponent.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def null_tokens(col: Column) -> Column:
    """Map the usual spellings of "no value" to null."""
    return F.when(~col.isin(*NULL_TOKENS), col)


def to_amount(col: Column) -> Column:
    """Number or null; text that is not a plain finite number is null."""
    text = col.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def to_day(col: Column, formats: Sequence[str] = ()) -> Column:
    """ISO date first, then each of the caller's formats; null when none fits."""
    text = F.trim(col.cast("string"))
    return F.coalesce(text.try_cast("date"), *(F.try_to_date(text, f) for f in formats))


def finite(col: Column) -> Column:
    """A number, or null where it is infinite or not a number."""
    return F.when(F.abs(col.cast("double")) < float("inf"), col)


def money(col: Column) -> Column:
    """Money as a decimal; a finite amount that does not fit raises rather than leave a total."""
    return finite(col).cast(MONEY)


def total(col: Column) -> Column:
    """Order-independent sum of money, as a decimal."""
    return F.sum(money(col))


def as_double(col: Column) -> Column:
    return col.cast("double")


def rounded(col: Column, places: int) -> Column:
    return F.round(col, places).cast("double")


def half_up(col: Column, places: int) -> Column:
    """Round a computed double half up, free of the noise of its last bits."""
    return F.round(finite(col).cast("decimal(28,8)"), places).cast("double")


def money_text(col: Column) -> Column:
    """``1,234.50``"""
    return F.format_number(F.round(money(col), 2), 2)


def plain_money_text(col: Column) -> Column:
    """``1234.50``"""
    return F.round(money(col), 2).cast("decimal(28,2)").cast("string")


def number_text(col: Column) -> Column:
    """Two fixed decimals for use inside documents."""
    return plain_money_text(col)


def day_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def month_start(col: Column) -> Column:
    return F.trunc(col, "month")


def month_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")
