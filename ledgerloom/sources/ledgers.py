"""Reading ledgers and images."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import clean


def read_csv(
    spark: SparkSession, path: str | list[str], numbered: bool = False, multi_line: bool = False
) -> DataFrame:
    """All columns as text; nothing is inferred, so the files are read once.

    ``numbered`` adds ``txn_id``, the position of the row over all files in path
    order. ``multi_line`` allows line breaks inside quotes, at the price of one
    task per file.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    return with_position(raw) if numbered else raw


def with_position(raw: DataFrame) -> DataFrame:
    """Number the rows of a file scan 0, 1, ... by file, split and line.

    Lines are numbered inside their split in parallel; only one count per split
    is put in global order.
    """
    split = ["_file", "_start"]
    placed = raw.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
    )
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*split).orderBy("_line")
    return (
        placed.join(offsets, split)
        .withColumn("txn_id", F.row_number().over(inside) - 1 + F.col("_before"))
        .drop(*split, "_line", "_before")
    )


def csv_from_text(spark: SparkSession, content: str) -> DataFrame:
    """A CSV document that the caller already holds as text."""
    records = list(csv.reader(io.StringIO(content)))
    if not records:
        raise clean.LedgerError("CSV file is empty")
    header, *body = records
    schema = ", ".join(f"`{name}` string" for name in header)
    for number, r in enumerate(body, 2):
        if len(r) > len(header):
            raise clean.LedgerError(f"Record {number} has {len(r)} fields, the header {len(header)}")
    rows = [tuple(r + [None] * (len(header) - len(r))) for r in body if r]
    return spark.createDataFrame(rows, schema)


def csv_from_column(df: DataFrame, column: str, header: Sequence[str]) -> DataFrame:
    """CSV lines held in a column, parsed next to the columns that came with them."""
    schema = ", ".join(f"`{name}` string" for name in header)
    parsed = df.withColumn("_row", F.from_csv(F.col(column), schema))
    return parsed.select(*(c for c in df.columns if c != column), "_row.*")


def load_ledger(
    spark: SparkSession, path: str | list[str], date_formats: Sequence[str] = ()
) -> tuple[DataFrame, str]:
    """Validated ledger and a status line, as an upload returns them."""
    typed = clean.coerce(clean.require_columns(read_csv(spark, path)), date_formats)
    status = clean.check_usable(typed)
    return clean.drop_incomplete(typed), status


def sample_ledger(spark: SparkSession) -> DataFrame:
    """Five rows for trying things out."""
    # The sample rows.
    rows = [
        ("2024-01-15", "Coffee Shop Downtown", 4.50, "Meals & Entertainment", "Morning coffee"),
        ("2024-01-16", "Shell Gas Station", 45.00, "Vehicle Expenses", "Regular gasoline"),
        ("2024-01-17", "Office Depot", 23.99, "Office Supplies", "Printer paper"),
        ("2024-01-18", "Uber Technologies", 18.75, "Travel", "Ride to meeting"),
        ("2024-01-19", "Microsoft Corporation", 99.99, "Software", "Office 365 subscription"),
    ]
    raw = spark.createDataFrame(rows, "date string, vendor string, amount double, category string, description string")
    return raw.withColumn("date", F.to_date("date"))


def read_images(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """Image files as bytes and base64 text, one row per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        "path",
        F.col("length").alias("bytes"),
        "content",
        F.base64("content").alias("image_base64"),
    )
