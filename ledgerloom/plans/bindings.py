"""Ledgers, statements, texts and vectors derived from the star-schema test tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ledger(spark: SparkSession, folder: str, session: str = "customer") -> DataFrame:
    """Every order as a ledger row; the session is its customer, or its customer's nation."""
    orders = table(spark, folder, "orders")
    part = table(spark, folder, "part")
    # Part keys count up from 0, so the remainder reaches every part.
    parts = part.agg(F.count(F.lit(1))).scalar()
    owner = F.col("o_custkey")
    if session == "nation":
        # Before the texts of the parts come to the rows.
        customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
        orders = orders.join(customer, orders.o_custkey == customer.c_custkey)
        owner = F.col("c_nationkey").cast("long")
    rows = orders.withColumn("p_partkey", F.col("o_orderkey") % parts).join(
        part.select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey"
    )
    return rows.select(
        owner.alias("session_id"),
        F.col("o_orderkey").alias("txn_id"),
        F.to_date("o_orderdate").alias("date"),
        F.concat_ws(" ", "p_name", "p_brand").alias("vendor"),
        F.col("o_totalprice").alias("amount"),
        F.col("p_type").alias("category"),
        F.col("p_type").alias("description"),
    )


def statement(rows: DataFrame) -> DataFrame:
    """Every ledger row as a bank would show it: later dates, other amounts, shorter names."""
    t = F.col("txn_id")
    return rows.select(
        "session_id",
        "txn_id",
        F.when(t % 5 == 2, F.date_add("date", 2)).otherwise(F.col("date")).alias("date"),
        F.when(t % 7 == 3, F.lit("Card payment"))
        .when(t % 3 == 0, F.split("vendor", " ")[0])
        .otherwise(F.col("vendor"))
        .alias("vendor"),
        F.when(t % 5 == 1, _raised("1.015"))
        .when(t % 5 == 4, _raised("1.5"))
        .otherwise(F.col("amount"))
        .alias("amount"),
        F.when(t % 7 != 3, F.col("description")).alias("description"),
    )


def sparse_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A ledger and statement with dates, vendors and descriptions missing, sessions on one side only,
    and statement ids that are not those of the ledger.
    """
    rows = ledger(spark, folder)
    t, sid = F.col("txn_id"), F.col("session_id")
    led = rows.where(sid % 5 != 1).withColumns(
        {
            "date": F.when(t % 6 != 1, F.col("date")),
            "vendor": F.when(t % 8 != 3, F.col("vendor")),
            "description": F.when(t % 4 != 2, F.col("description")),
        }
    )
    stm = statement(rows.where(sid % 5 != 3)).withColumns(
        {"date": F.when(t % 9 != 4, F.col("date")), "amount": F.when(t % 10 != 7, F.col("amount")), "txn_id": 2 * t + 11}
    )
    return led, stm


def dirty_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger as text, with the faults real files have."""
    t = F.col("txn_id")
    iso = F.date_format("date", "yyyy-MM-dd")
    return ledger(spark, folder).select(
        "txn_id",
        F.when(t % 11 == 3, "not a date")
        .when(t % 11 == 5, F.date_format("date", "MM/dd/yyyy"))
        .otherwise(iso)
        .alias("date"),
        F.when(t % 17 == 4, "").when(t % 17 == 6, "N/A").otherwise(F.col("vendor")).alias("vendor"),
        F.when(t % 7 == 1, "abc")
        .when(t % 7 == 2, "1,000")
        .when(t % 13 == 3, "nan")
        .when(t % 13 == 5, "")
        .otherwise(_plain(F.col("amount")))
        .alias("amount"),
        "category",
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """One extraction response per order, in the shapes models return."""
    t = F.col("txn_id")
    day = F.date_format("date", "yyyy-MM-dd")
    amount = _plain(F.col("amount"))
    say = lambda *p: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in p))
    text = (
        F.when(
            t % 7 == 0,
            say('Here: [{"date":"', day, '","amount":"', amount, '","vendor":"', F.col("vendor"),
                ' LLC","description":"', F.col("description"), '","type":" Credit "}] ok'),
        )
        .when(t % 7 == 1, '[{"amount":true,"vendor":null},"x",5]')
        .when(t % 7 == 2, '[{"amount":"bad","vendor":"q"},{"vendor":"z"},{"amount":1e2,"vendor":7}]')
        .when(t % 7 == 3, "no transactions found")
        .when(t % 7 == 4, "] [")
        .when(t % 7 == 5, '[{"a":1},]')
        .otherwise(
            say('Result: [{"date":"', day, '","amount":', amount, ',"vendor":"', F.col("vendor"),
                ' & co","description":" ', F.col("description"), ' "},{"date":"', day, '","amount":', amount,
                ',"vendor":"', F.col("vendor"), '","description":null}] end')
        )
    )
    return ledger(spark, folder).select(
        "session_id", F.concat(F.lit("scan-"), t.cast("string"), F.lit(".png")).alias("filename"), text.alias("response")
    )


def vector_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every ledger row's text with its own embedding."""
    from ledgerloom.operators.documents import index_text
    from ledgerloom.operators.vectors import embed_text

    rows = ledger(spark, folder)
    return embed_text(rows.select(F.col("txn_id").alias("doc_id"), "amount", index_text(rows).alias("text")))


def _plain(col: Column) -> Column:
    return col.cast("decimal(18,2)").cast("string")


def _raised(factor: str) -> Column:
    """Amount times a factor, rounded half up to cents."""
    return F.round(F.col("amount").cast("decimal(18,2)") * F.lit(Decimal(factor)), 2).cast("double")
