"""Fixed column sets, missing-value tokens and Spark types shared by the package."""

from __future__ import annotations

from pyspark.sql import types as T

REQUIRED_COLUMNS = ("date", "vendor", "amount")
LEDGER_COLUMNS = ("date", "vendor", "amount", "category", "description")

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("txn_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("vendor", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

STATEMENT_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("txn_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("vendor", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("extracted_at", T.TimestampType()),
    ]
)

# Text that a ledger file uses for "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Money is summed as decimals so that totals do not depend on row order.
MONEY = "decimal(28,4)"
