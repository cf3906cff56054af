"""Writing ledgers, records and reconciliation results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def records(df: DataFrame, out: str = "record") -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
