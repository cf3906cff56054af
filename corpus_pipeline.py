"""From raw documents to packed sequences: five stages, each over all its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). All but the last
return the columns of documents. A decision holds for its row alone, whatever ids are null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, exact, packing, queries, simhash, toxicity
from ledgerloom.llm.store import fresh_folder, written

def _row(docs: DataFrame) -> str:
    """A column name that the documents do not have."""
    name = "_stage_row"
    while name in docs.columns:
        name += "_"
    return name


def _by_text(docs: DataFrame, row: str) -> DataFrame:
    """The documents with their id and text digest as key, for decisions that only the text settles."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.withColumn(row, F.struct(F.col("doc_id").alias("id"), digest.alias("digest")))


def _keyed(docs: DataFrame, row: str) -> DataFrame:
    """The documents, written with a number no other row has."""
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "keyed-documents")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity limit."""
    row = _row(docs)
    keyed = _by_text(docs, row)
    scores = toxicity.score(keyed, queries.toxicity_model(spark, sf_dir), row)
    return keyed.join(scores.filter(F.col("score") >= queries.TOXIC).select(row), row, "left_anti").drop(row)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest id."""
    row = _row(docs)
    keyed = _keyed(docs, row)
    # A null id is smallest; rows with equal ids are told apart by text and number.
    order = F.struct("doc_id", F.xxhash64("text").alias("digest"), F.col(row).alias("row"))
    found = exact.exact_duplicates(keyed.select(order.alias("order"), "text"), "order")
    gone = found.filter(~F.col("kept")).select(F.col("order.row").alias(row))
    return keyed.join(gone, row, "left_anti").drop(row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Near copies are linked by fingerprints of four-word shingles that differ in at most four bits.
    """
    row = _row(docs)
    keyed = _keyed(docs, row)
    # A null id is largest; rows with equal ids are told apart by text and number.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("digest"), F.col(row).alias("row"))
    found = simhash.near_duplicates(keyed.select(order.alias("order"), "text"), "order", distance=simhash.DISTANCE)
    gone = found.filter(F.col("order") != F.col("component_id")).select(F.col("order.row").alias(row))
    return keyed.join(gone, row, "left_anti").drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = _row(docs)
    keyed = _by_text(docs, row)
    found = decontam.judged(decontam.contamination(keyed, benchmark, row), row)
    return keyed.join(found.filter("contaminated").select(row), row, "left_anti").drop(row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences."""
    return packing.packed_documents(docs, queries._vocabulary("byte_bpe_50k.json"), queries.END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Learnt scores, 64-bit shingle hashes and token ids are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage returns is written, and read as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_folder(spark, "corpus-pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
