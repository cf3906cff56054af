"""Text embedding and exact cosine retrieval."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from ledgerloom.functions import text

# Retrieval depth, similarity floor and context length.
TOP_K = 5
MIN_SIMILARITY = 0.1
CONTEXT_TEXTS = 3

QUERY_BLOCK = 1000


def embed_text(
    df: DataFrame,
    encoder: Callable[[Column], Column] | None = None,
    column: str = "text",
    dims: int = 64,
    out: str = "embedding",
) -> DataFrame:
    """Add an embedding of a text column.

    ``encoder`` is the caller's vectorised UDF. Without one, words are hashed
    into ``dims`` counts (by the first sixteen bits of their MD5) and the vector is
    scaled to unit length.
    """
    if encoder is not None:
        return df.withColumn(out, encoder(F.col(column)))
    words = F.coalesce(text.words(F.lower(F.col(column))), F.array().cast("array<string>"))
    return df.withColumn(out, _hashed(dims)(words))


def _hashed(dims: int):
    """Words to counts of their places, scaled to unit length; a batch is counted at once, and each of its different words hashed once."""

    @F.arrow_udf(ArrayType(FloatType()))
    def count(words: pa.Array) -> pa.Array:
        n = len(words)
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        coded = words.flatten().dictionary_encode()
        place = np.array([int.from_bytes(md5(w.encode(), usedforsecurity=False).digest()[:2], "big") % dims for w in coded.dictionary.to_pylist()], np.int64)
        at = row * dims + place[coded.indices.to_numpy()]
        counts = np.bincount(at, minlength=n * dims).astype(np.float64).reshape(n, dims)
        size = np.sqrt(np.einsum("ij,ij->i", counts, counts))
        unit = counts / np.where(size > 0, size, 1.0)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(unit.astype(np.float32).ravel()))

    return count


@F.arrow_udf(DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine similarity to nine decimals, so that equal ones tie; 0 when a vector is null or has no length.

    A batch is one multiplication of matrices; lambdas over array elements cost a hundred times more.
    """
    known = pc.and_(pc.is_valid(a), pc.is_valid(b))
    out = np.zeros(len(a))
    x, y = matrix(a.filter(known)), matrix(b.filter(known))
    if x.size:
        out[known.to_numpy(zero_copy_only=False)] = _cosines(x, y)
    return pa.array(out)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of an array of equally long lists."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def similar_transactions(
    index: DataFrame,
    query: Column,
    k: int = TOP_K,
    min_similarity: float = MIN_SIMILARITY,
    id_column: str = "doc_id",
) -> DataFrame:
    """The ``k`` nearest rows of the index above the similarity floor.

    ``query`` is one vector, given as a literal array or a scalar subquery, which is worked
    out first. The scan needs no join and ends in a top-k per task and a merge.
    """
    # One vector comes to the driver and goes to the tasks as a literal.
    asked = index.sparkSession.range(1).select(query.cast("array<double>").alias("v")).collect()[0]["v"]
    scored = index.withColumn("similarity", cosine(F.col("embedding").cast("array<double>"), F.lit(asked).cast("array<double>")))
    nearest = scored.orderBy(F.desc("similarity"), F.desc(id_column)).limit(k)
    return nearest.where(F.col("similarity") > min_similarity)


def similar_batch(
    index: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    min_similarity: float = MIN_SIMILARITY,
    id_column: str = "doc_id",
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """Nearest rows for every query of a table (query_id, vector).

    Queries are counted first. They go to the tasks in blocks of about ``block``
    vectors, so what is broadcast is bounded however many there are; each block meets
    every row. Only the best rows of an Arrow batch leave it, and the per-query rank prunes
    them again before anything moves.
    """
    blocks = max(1, -(-queries.count() // block))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        asked = queries.where(number == b).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        scored = nearest_in_batches(index, asked.toArrow(), k, min_similarity, id_column)
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc(id_column))
        found = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = found if out is None else out.unionByName(found)
    return out


def nearest_in_batches(
    index: DataFrame,
    asked: pa.Table,
    k: int,
    min_similarity: float,
    id_column: str,
    which: Callable[[pa.RecordBatch], list] | None = None,
) -> DataFrame:
    """(query_id, columns of the index without embedding, similarity): of every batch of rows the ``k`` nearest to each query.

    ``asked`` (query_id, vector) goes to the tasks whole. ``which`` gives stretches of a batch and the numbers of the
    queries that can have their nearest rows there: (first row, end, numbers); without it every row meets every query.
    """
    kept = [c for c in index.columns if c != "embedding"]
    rows = index.select("embedding", *kept)
    ids = asked.column("query_id").combine_chunks()
    shared = index.sparkSession.sparkContext.broadcast((ids, filled(asked.column("vector").combine_chunks())))
    at = 1 + kept.index(id_column)

    def run(batches):
        ids, questions = shared.value
        scaled = unit(questions)
        for batch in batches:
            x = filled(batch.column(0))
            # Places of the rows in descending order of ids, nulls last.
            place = np.empty(len(x), np.int64)
            place[pc.sort_indices(batch.column(at), sort_keys=[("", "descending")]).to_numpy()] = np.arange(len(x))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for first, end, numbers in [(0, len(x), np.arange(len(ids)))] if which is None else which(batch):
                # About so many products at a time.
                step = max(1, 1_000_000 // max(1, end - first))
                for a in range(0, len(numbers), step):
                    part = numbers[a : a + step]
                    row, query, similarity = _best(x[first:end], place[first:end], questions[part], scaled[part], k, min_similarity)
                    found.append((row + first, part[query], similarity))
            row, query, similarity = (np.concatenate(c) for c in zip(*found))
            best = _firsts(row, query, similarity, place, k)
            columns = [batch.column(1 + c).take(pa.array(row[best])) for c in range(len(kept))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[best])), *columns, pa.array(similarity[best])], ["query_id", *kept, "similarity"])

    fields = [StructField("query_id", from_arrow_type(ids.type)), *(index.schema[c] for c in kept), StructField("similarity", DoubleType())]
    return rows.mapInArrow(run, StructType(fields))


def _firsts(row: np.ndarray, query: np.ndarray, similarity: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which of the finds are the first ``k`` of their query, by similarity and then by place."""
    order = np.lexsort((place[row], -similarity, query))
    own = query[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return order[rank < k]


def _best(x: np.ndarray, place: np.ndarray, questions: np.ndarray, scaled: np.ndarray, k: int, least: float) -> tuple[np.ndarray, ...]:
    """(rows, queries, similarities): the ``k`` nearest rows of every query whose similarity is above ``least``."""
    if not len(x) or not questions.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    near = unit(x) @ scaled.T
    bar = np.full(len(questions), float(least))
    if len(x) > k:
        bar = np.maximum(bar, np.partition(near, len(x) - k, axis=0)[len(x) - k])
    # Products of matrices differ from single ones in their last digits, so the bar is a little lower.
    row, query = np.nonzero(near >= bar - 1e-8)
    # In parts: many rows may be as good as the last.
    similarity = np.concatenate([_cosines(x[row[a : a + 50_000]], questions[query[a : a + 50_000]]) for a in range(0, max(1, len(row)), 50_000)])
    good = similarity > least
    row, query, similarity = row[good], query[good], similarity[good]
    best = _firsts(row, query, similarity, place, k)
    return row[best], query[best], similarity[best]


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of row and row to nine decimals; 0 where one has no length."""
    norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
    dots = np.einsum("ij,ij->i", x, y)
    return np.where(norms > 0, np.round(dots / np.where(norms > 0, norms, 1.0), 9), 0.0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; those without length stay."""
    size = np.sqrt((x**2).sum(1))[:, None] if x.size else np.ones((len(x), 1))
    return x / np.where(size > 0, size, 1.0)


def filled(vectors: pa.Array) -> np.ndarray:
    """Rows of an array of equally long lists, noughts where one is missing."""
    if not vectors.null_count:
        return matrix(vectors)
    x = matrix(vectors.drop_null())
    out = np.zeros((len(vectors), x.shape[1]))
    out[vectors.is_valid().to_numpy(zero_copy_only=False)] = x
    return out


def retrieval_context(
    matches: DataFrame, n: int = CONTEXT_TEXTS, id_column: str = "doc_id", amount: str | None = "amount"
) -> DataFrame:
    """The best texts joined by line breaks, the number of matches and their summed amount.

    ``matches`` is a top-k result, so the rows gathered here are bounded by k.
    """
    w = Window.orderBy(F.desc("similarity"), F.desc(id_column))
    ranked = matches.withColumn("_rank", F.row_number().over(w))
    texts = F.collect_list(F.when(F.col("_rank") <= n, F.struct("_rank", "text")))
    money = F.sum(F.col(amount).cast("decimal(28,4)")).cast("double") if amount else F.lit(None)
    return ranked.agg(
        F.array_join(F.transform(F.array_sort(texts), lambda s: s["text"]), "\n").alias("context"),
        F.count(F.lit(1)).alias("matching_transactions"),
        F.coalesce(money, F.lit(0.0)).alias("total_amount"),
    )
