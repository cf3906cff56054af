"""Best-fit packing of token sequences by patterns.

``cut`` encodes texts and cuts what is longer than a sequence. ``pack`` puts the pieces
into sequences: the histogram of lengths (at most ``capacity`` numbers, however many
documents there are) is fitted by patterns of one to three lengths that fill a sequence,
with repeat counts from non-negative least squares; the counts are rounded and what is
left over is packed best-fit, all on the histogram, and of a few shares of the fit the one
that needs fewest sequences is taken. The resulting runs say which ranks
of a length go where, so every piece only needs its rank among the pieces of its length.

Defined results: a null text is an empty document, which has the end id alone; repeated
rows and equal ids are packed each; a null id stays null; an empty table gives an empty
table. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.store import written
from ledgerloom.llm.tokens import encoder

CAPACITY = 1024
FIT_ROUNDS = 300
SHARES = (1.0, 0.9, 0.5, 0.0)
# Arrow batches that leave a task hold about so many bytes of ids.
OUT_BYTES = 8 << 20


def cut(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    checksums: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids): ids as little-endian unsigned 32-bit integers.

    Only documents longer than ``capacity`` are cut, into pieces of exactly that length
    but for the first, which takes the remainder. With ``checksums`` the last column is
    ``ids_crc32`` instead, so that the ids need not leave the worker.
    """
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"))
    content = F.lit(0).cast("long").alias("ids_crc32") if checksums else F.lit(b"").alias("ids")
    schema = rows.select(
        F.col(id_col),
        F.lit(0).alias("piece"),
        F.lit(0).cast("long").alias("start"),
        F.lit(0).cast("long").alias("length"),
        content,
    ).schema
    last = np.array([end_id], "<u4").tobytes()
    kind = pa.int64() if checksums else pa.binary()
    taken = zlib.crc32 if checksums else bytes

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer).encode_all
        for batch in batches:
            held, sources, pieces, starts, lengths, contents = 0, [], [], [], [], []

            def flush() -> pa.RecordBatch:
                columns = [pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(contents, kind)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sources, pa.int64())), *columns], schema.names)

            for row, ids in enumerate(encode_all(batch.column(1))):
                ids += last
                n = len(ids) // 4
                if n <= capacity:
                    sources.append(row)
                    pieces.append(0)
                    starts.append(0)
                    lengths.append(n)
                    contents.append(taken(ids))
                else:
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    view = memoryview(ids)
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        sources.append(row)
                        pieces.append(k)
                        starts.append(a)
                        lengths.append(b - a)
                        contents.append(taken(view[4 * a : 4 * b]))
                held += len(ids)
                if held > OUT_BYTES and not checksums:
                    yield flush()
                    held, sources, pieces, starts, lengths, contents = 0, [], [], [], [], []
            if sources:
                yield flush()

    return rows.mapInArrow(encode, schema)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three lengths (0: none), ascending, that fill a sequence exactly."""
    has = np.zeros(capacity + 1, bool)
    has[lengths] = True
    has[0] = False
    a, b = np.meshgrid(np.flatnonzero(np.r_[True, has[1:]]), np.flatnonzero(np.r_[True, has[1:]]), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = capacity - a - b
    # A shorter pattern starts with noughts: (0, 0, c), (0, b, c), (a, b, c).
    ok = (a <= b) & (b <= c) & ((a > 0) | (b >= 0))
    a, b, c = a[ok], b[ok], c[ok]
    ok = has[c]
    return np.stack([a[ok], b[ok], c[ok]], 1)


def fit(pattern: np.ndarray, histogram: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative repeat counts that come nearest to the histogram in least squares."""
    if not len(pattern):
        return np.zeros(0)
    size = len(histogram)
    target = histogram.astype(float)
    target[0] = 0

    def used(x):
        out = sum(np.bincount(pattern[:, j], x, size) for j in range(3))
        out[0] = 0
        return out

    # A bound of the largest eigenvalue: the most a pattern's row can add up to.
    step = 1.0 / max(1.0, float((used(np.ones(len(pattern)))[pattern].sum(1)).max()))
    x = np.zeros(len(pattern))
    y, t = x, 1.0
    for _ in range(rounds):
        gradient = (used(y) - target)[pattern].sum(1)
        new = np.maximum(0.0, y - step * gradient)
        following = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / following * (new - x)
        x, t = new, following
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, end rank, first sequence, offset) that place every piece.

    The piece of rank r in a run goes to sequence ``first sequence + r - first rank``.
    The fit is used in full and in parts, since a looser fit leaves more room to best fit;
    the runs that need fewest sequences are returned.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    known = patterns(np.flatnonzero(counts), capacity)
    fitted = fit(known, counts)
    found = [_runs(counts.copy(), known, share * fitted, capacity) for share in SHARES]
    return min(found, key=lambda runs: (runs[:, 3] + runs[:, 2] - runs[:, 1]).max(initial=0))


def _runs(left: np.ndarray, known: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Runs for rounded pattern counts, the rest packed best-fit."""
    taken = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequences
        at = 0
        for length in lengths:
            runs.append((length, int(taken[length]), int(taken[length]) + times, sequences, at))
            taken[length] += times
            left[length] -= times
            at += length
        sequences += times

    # Rounding sums instead of single counts keeps the totals of neighbouring patterns.
    whole = np.diff(np.floor(np.r_[0.0, np.cumsum(counts)] + 0.5)).astype(np.int64)
    for k in np.argsort(-whole, kind="stable"):
        if whole[k] <= 0:
            break
        lengths = [int(x) for x in known[k] if x]
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(whole[k]), *(int(left[x]) // n for x, n in need.items()))
        if times:
            place(lengths, times)

    # Best fit on the rest, longest first; groups of equal sequences are handled at once.
    groups: dict[int, list[list]] = defaultdict(list)  # free space -> [lengths, times]
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, capacity) if groups.get(r)), None)
            if room is None:
                each = capacity // length
                times = max(1, n // each)
                each = min(each, n)
                groups[capacity - each * length].append([[length] * each, times])
                n -= each * times
                continue
            lengths, times = groups[room].pop()
            m = min(times, n)
            if times > m:
                groups[room].append([lengths, times - m])
            groups[room - length].append([[*lengths, length], m])
            n -= m
    for room in list(groups):
        for lengths, times in groups[room]:
            place(lengths, times)
    return np.array(runs, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    ``pieces`` is read three times; write it first if it is dear. A length that many pieces
    share is ranked in as many parts as there are shuffle partitions.
    """
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    counts = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``capacity`` rows.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_part").orderBy(*keys)
    ranked = (
        pieces.withColumn("_row", F.row_number().over(within) - 1)
        .join(offsets, ["length", "_part"])
        .withColumn("_rank", F.col("_row") + F.col("_before"))
    )
    place = _placer(spark, plan(totals, capacity))
    return (
        ranked.withColumn("_place", place(F.col("length"), F.col("_rank")))
        .withColumn("sequence_id", F.col("_place.sequence_id"))
        .withColumn("offset", F.col("_place.offset"))
        .drop("_part", "_row", "_before", "_rank", "_place")
    )


def _placer(spark, runs: np.ndarray):
    """A lookup of runs. Their number is bounded by the patterns of ``capacity``, not by the data."""
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    shared = spark.sparkContext.broadcast(runs[order])
    wide = 1 << 44

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        table = shared.value
        run = np.searchsorted(table[:, 0] * wide + table[:, 1], length.to_numpy() * wide + rank.to_numpy(), "right") - 1
        row = table[run]
        return pd.DataFrame({"sequence_id": row[:, 3] + rank.to_numpy() - row[:, 1], "offset": row[:, 4]})

    return place


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document with a checksum of their ids and their place."""
    pieces = cut(docs, tokenizer, end_id, capacity, checksums=True)
    return pack(written(pieces, "pieces"), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
