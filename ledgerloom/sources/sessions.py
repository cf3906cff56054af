"""Session tables on shared storage, one per kind of record, bucketed by session."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SessionNotFound(LookupError):
    """No rows are stored for the session."""


# The kinds of record kept per session.
KINDS = ("ledger", "active", "statement", "reconciliation")


# Names the store adds to its tables.
BUCKET, VERSION = "_bucket", "_version"
BUCKETS = 256


def _bucket(session_id: Column) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(BUCKETS)).cast("int")


def _newest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy(F.col("session_id").alias("_sid")).agg(F.max(VERSION).alias("_last"))
    kept = rows.join(last, F.col("session_id").eqNullSafe(F.col("_sid")) & (F.col(VERSION) == F.col("_last")), "left_semi")
    return kept.drop(BUCKET, VERSION)


class SessionStore:
    """Reads and writes the per-session tables under one root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, kind: str) -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown kind: {kind}")
        return f"{self.root}/{kind}"

    def upsert(self, kind: str, df: DataFrame) -> None:
        """Replace the sessions present in ``df``; other sessions stay as they are.

        Rows are appended under a newer version to ``BUCKETS`` folders by the hash of
        their session, so the number of folders does not grow with the sessions. The
        rebalancing gives small buckets one file and splits large ones.
        """
        if "session_id" not in df.columns:
            raise ValueError("session_id column needed")
        stamped = df if "created_at" in df.columns else df.withColumn("created_at", F.current_timestamp())
        rows = stamped.withColumns(
            {"session_id": F.col("session_id").cast("string"), VERSION: F.lit(time.time_ns())}
        ).withColumn(BUCKET, _bucket(F.col("session_id")))
        rows.hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET).parquet(self.path(kind))

    def read(self, kind: str) -> DataFrame:
        """The newest version of every session of one kind."""
        return _newest(self.spark.read.parquet(self.path(kind)))

    def lookup(self, kind: str, session_id: str) -> DataFrame:
        """Rows of one session: one bucket is listed, and the filter reaches the scan."""
        rows = self.spark.read.parquet(self.path(kind))
        here = (F.col(BUCKET) == _bucket(F.lit(session_id))) & (F.col("session_id") == F.lit(session_id))
        found = _newest(rows.where(here))
        if found.isEmpty():
            raise SessionNotFound(f"Session not found: {session_id} ({kind})")
        return found

    def activate(self, session_ids: DataFrame) -> None:
        """Mark sessions as active."""
        rows = session_ids.select("session_id").distinct().withColumn("status", F.lit("active"))
        self.upsert("active", rows)


def session_catalog(df: DataFrame, created: str = "created_at") -> DataFrame:
    """Number of rows and newest record per session."""
    return df.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.max(created).alias("created_at")
    )


def session_count(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("session_id").alias("session_count"))


def new_session_id():
    """``session_<8 hex>_<yyyyMMdd_HHmmss>``; a new value for every row and run."""
    return F.concat(
        F.lit("session_"),
        F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 8),
        F.lit("_"),
        F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"),
    )
