"""Free-text extraction responses turned into typed statement transactions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text, values
from ledgerloom.operators.clean import iso_day

# Tags and limits of extracted transactions.
SOURCE_TAG = "image_extraction"
DEFAULT_TYPE = "debit"
STRICT_FIELDS = ("date", "amount", "vendor", "description")
LOOSE_KEYS = ("amount", "vendor")
RAW_RESPONSE_CHARS = 500


def response_elements(df: DataFrame, column: str = "response") -> DataFrame:
    """One row per element of the JSON array inside each response.

    Text without an array, or whose array is not valid JSON, has no elements.
    """
    parsed = F.try_parse_json(text.bracketed_array(F.col(column)))
    spark = df.sparkSession
    exploded = df.withColumn("_array", parsed).lateralJoin(
        spark.tvf.variant_explode(F.col("_array").outer())
    )
    return exploded.drop("_array", "key").withColumnRenamed("pos", "position")


def parse_responses(
    df: DataFrame, rules: str = "deployed", column: str = "response", date_formats: Sequence[str] = ()
) -> DataFrame:
    """Typed transactions of all responses.

    ``rules="deployed"`` keeps objects that have the keys amount and vendor and
    a numeric amount. ``rules="strict"`` needs date, amount, vendor and
    description to be present and not null, and also cleans the values.
    A date that is not ISO is read by the first of ``date_formats`` that fits.
    """
    if rules not in ("deployed", "strict"):
        raise ValueError(f"unknown rules: {rules}")
    carried = [c for c in df.columns if c != column]
    value = F.col("value")
    fields = response_elements(df, column).select(
        *carried,
        "position",
        F.json_object_keys(F.to_json(value)).alias("_keys"),
        _number(value, "amount").alias("amount"),
        *(_string(value, name).alias(f"_{name}") for name in ("date", "vendor", "description", "type")),
        _kind(value, "type").alias("_type_kind"),
    )
    numeric = fields.where(F.col("amount").isNotNull())
    finish = _strict if rules == "strict" else _deployed
    return finish(numeric, carried, date_formats)


def extraction_envelope(
    responses: DataFrame, rules: str = "deployed", column: str = "response", keys=("session_id", "filename")
) -> DataFrame:
    """Status, number of extracted transactions and the start of the raw text, per response.

    Elements are counted inside the row, so nothing moves and equal keys stay apart.
    """
    if rules not in ("deployed", "strict"):
        raise ValueError(f"unknown rules: {rules}")
    parsed = F.try_parse_json(text.bracketed_array(F.col(column)))
    elements = F.try_variant_get(parsed, "$", "array<variant>")
    valid = F.filter(elements, lambda v: F.coalesce(_extracted(v, rules), F.lit(False)))
    return responses.select(
        *keys,
        F.lit("success").alias("status"),
        F.coalesce(F.size(valid), F.lit(0)).cast("long").alias("total_transactions"),
        F.substring(text.strip(F.col(column)), 1, RAW_RESPONSE_CHARS).alias("raw_response"),
    )


def _extracted(value: Column, rules: str) -> Column:
    """Whether an element becomes a transaction; the rules of ``parse_responses``."""
    keys = F.json_object_keys(F.to_json(value))
    kept = _number(value, "amount").isNotNull()
    if rules == "deployed":
        for key in LOOSE_KEYS:
            kept = kept & F.array_contains(keys, key)
        return kept
    for name in STRICT_FIELDS:
        if name != "amount":
            kept = kept & _string(value, name).isNotNull()
    return kept & (~F.array_contains(keys, "type") | (_kind(value, "type") == "STRING"))


def extract_responses(
    images: DataFrame, extractor: Callable[[Iterator], Iterator], schema: str
) -> DataFrame:
    """Run the caller's model over batches of images, partition by partition."""
    return images.mapInPandas(extractor, schema)


def _day(raw: Column, formats: Sequence[str]) -> Column:
    return F.coalesce(iso_day(raw), *(F.try_to_date(text.strip(raw), f) for f in formats))


def _deployed(fields: DataFrame, carried: list[str], formats: Sequence[str]) -> DataFrame:
    has = F.lit(True)
    for key in LOOSE_KEYS:
        has = has & F.array_contains("_keys", key)
    return fields.where(F.coalesce(has, F.lit(False))).select(
        *carried,
        "position",
        _day(F.col("_date"), formats).alias("date"),
        "amount",
        F.col("_vendor").alias("vendor"),
        F.col("_description").alias("description"),
        F.col("_type").alias("type"),
        F.lit(SOURCE_TAG).alias("source"),
        F.current_timestamp().alias("extracted_at"),
    )


def _strict(fields: DataFrame, carried: list[str], formats: Sequence[str]) -> DataFrame:
    complete = F.lit(True)
    for name in STRICT_FIELDS:
        complete = complete & F.col(name if name == "amount" else f"_{name}").isNotNull()
    typed = ~F.array_contains("_keys", "type") | (F.col("_type_kind") == "STRING")
    kept = fields.where(complete & F.coalesce(typed, F.lit(False)))
    return kept.select(
        *carried,
        "position",
        _day(F.col("_date"), formats).alias("date"),
        "amount",
        text.standard_vendor(F.col("_vendor")).alias("vendor"),
        text.strip(F.col("_description")).alias("description"),
        F.coalesce(F.lower(text.strip(F.col("_type"))), F.lit(DEFAULT_TYPE)).alias("type"),
        F.lit(SOURCE_TAG).alias("source"),
        F.current_timestamp().alias("extracted_at"),
    )


def _string(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def _kind(value: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))


def _number(value: Column, name: str) -> Column:
    """A JSON number, a truth value as 0 or 1, or text that spells a plain number."""
    spelled = F.regexp_replace(_string(value, name), r"(?<=\d)_(?=\d)", "")
    return F.when(_kind(value, name) == "STRING", values.to_amount(spelled)).otherwise(
        F.try_variant_get(value, f"$.{name}", "double")
    )
