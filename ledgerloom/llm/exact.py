"""Exact deduplication by Grace hashing with complete comparison.

A scan window first collapses its own equal texts, so that a text with very many copies
moves once per window. Spark's shuffle then is the first partitioning by hash. A task
whose partition does not fit its memory partitions it again by the next digits of the
hash into spill files in the shared folder, and those again, until a bucket fits. A bucket
is resolved in an open-addressing table that compares complete texts; it holds each
different text once, however many copies there are.

Texts are equal when identical after lower-casing A-Z only. The row with the largest id
stays.

Defined results: a null text counts as empty; rows that share the largest id all stay;
a null id never wins against another, and a group of nothing but null ids stays whole; an
empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import file_system, fresh_folder, written

WINDOW_BYTES = 32 << 20
BUCKET_BYTES = 96 << 20
FANOUT_BITS = 4
DEEPEST = 64 // FANOUT_BITS
# What a row's id takes in memory, about.
ROW_BYTES = 64


class OpenTable:
    """Texts by open addressing with linear probing; equal means the same bytes."""

    def __init__(self, bits: int = 10):
        self.slots = [-1] * (1 << bits)
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def place(self, hashed: int, text: bytes) -> int:
        """Number of the text, a new one if no equal text is there."""
        slots = self.slots
        mask = len(slots) - 1
        # The low digits choose spill files, so the table starts from the high ones.
        at = (hashed >> 20) & mask
        while (n := slots[at]) >= 0:
            if self.hashes[n] == hashed and self.texts[n] == text:
                return n
            at = (at + 1) & mask
        n = slots[at] = len(self.texts)
        self.hashes.append(hashed)
        self.texts.append(text)
        self.bytes += len(text) + 100
        if 2 * len(self.texts) > len(slots):
            self._grow()
        return n

    def _grow(self) -> None:
        slots = self.slots = [-1] * (4 * len(self.slots))
        mask = len(slots) - 1
        for n, hashed in enumerate(self.hashes):
            at = (hashed >> 20) & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = n


def resolve(
    rows: Iterable[tuple[int, bytes, object]], bucket_bytes: int, spill: str, depth: int = 0
) -> Iterator[tuple[bytes, object]]:
    """(name of the text, what came with the row) for (hash, text, what comes with it).

    Rows get one name exactly when their texts are equal. What came with them is handed on
    whenever it takes ``bucket_bytes`` itself, so one text may have any number of rows. Beyond
    ``bucket_bytes`` of different texts the rows go to spill files under ``spill`` by the hash's digits at
    ``depth``.
    """
    table, waiting, held = OpenTable(), [], 0
    names: list[bytes] = []
    seen: dict[bytes, int] = {}

    def named() -> Iterator[tuple[bytes, object]]:
        for text in table.texts[len(names) :]:
            sha = hashlib.sha256(text).digest()
            # Different texts never share a name, even if they shared a digest.
            again = seen[sha] = seen.get(sha, -1) + 1
            names.append(sha + again.to_bytes(2, "big") if again else sha)
        for n, extra in waiting:
            yield names[n], extra

    rows = iter(rows)
    for hashed, text, extra in rows:
        waiting.append((table.place(hashed, text), extra))
        held += ROW_BYTES * (1 + (len(extra) if isinstance(extra, list) else 0))
        if table.bytes > bucket_bytes and len(table.texts) > 1 and depth < DEEPEST:
            break
        if held > bucket_bytes:
            # Rows of known texts need not wait: a name follows from its text.
            yield from named()
            waiting, held = [], 0
    else:
        yield from named()
        return
    fs, folder = file_system(f"{spill}/{depth}-{uuid.uuid4().hex}")
    fs.create_dir(folder, recursive=True)
    digits = 1 << FANOUT_BITS
    files = [fs.open_output_stream(f"{folder}/{k}", compression=None) for k in range(digits)]
    try:
        for row in ((table.hashes[n], table.texts[n], extra) for n, extra in waiting):
            pickle.dump(row, files[row[0] >> (FANOUT_BITS * depth) & (digits - 1)])
        del table, waiting
        for row in rows:
            pickle.dump(row, files[row[0] >> (FANOUT_BITS * depth) & (digits - 1)])
        for f in files:
            f.close()
        for k in range(digits):
            with fs.open_input_stream(f"{folder}/{k}", compression=None) as stream:
                yield from resolve(_load(stream), bucket_bytes, spill, depth + 1)
    finally:
        for f in files:
            f.close()
        fs.delete_dir(folder)


def _load(stream) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(stream)
        except EOFError:
            return


def windows(docs: DataFrame, id_col: str, text_col: str, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """(hash, text, ids): the normalised texts of each scan window, each once with its rows."""
    from pyspark.sql.types import ArrayType

    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"))
    kind = rows.schema[id_col].dataType
    schema = rows.select(
        F.lit(0).cast("long").alias("hash"), F.lit(b"").alias("text"), F.lit(None).cast(ArrayType(kind)).alias("ids")
    ).schema

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table, ids, held = OpenTable(), [], 0

        def flush(id_type):
            hashes = np.array(table.hashes, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(hashes), pa.array(table.texts, pa.binary()), pa.array(ids, pa.list_(id_type))], ["hash", "text", "ids"]
            )

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode().lower()
                n = table.place(xxhash.xxh64_intdigest(data), data)
                if n == len(ids):
                    ids.append([])
                ids[n].append(row_id)
                held += ROW_BYTES
                if table.bytes + held > window_bytes:
                    yield flush(id_type)
                    table, ids, held = OpenTable(), [], 0
        if ids:
            yield flush(id_type)

    return rows.mapInArrow(collapse, schema)


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window_bytes: int = WINDOW_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    spark = docs.sparkSession
    spill = fresh_folder(spark, "grace-spill")
    seen = windows(docs, id_col, text_col, window_bytes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = seen.select(F.lit(b"").alias("name"), "ids").schema

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = []

        def rows():
            for batch in batches:
                kinds.append(batch.column(2).type)
                hashes = batch.column(0).to_numpy().view(np.uint64).tolist()
                yield from zip(hashes, batch.column(1).to_pylist(), batch.column(2).to_pylist())

        names, ids, held = [], [], 0
        for name, some in resolve(rows(), bucket_bytes, spill):
            names.append(name)
            ids.append(some)
            held += len(some)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, kinds[0])], ["name", "ids"])
                names, ids, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, kinds[0])], ["name", "ids"])

    # One row per text and window from here on; texts stay behind.
    named = written(seen.repartition(parts, "hash").mapInArrow(settle, schema), "named-texts")
    groups = named.groupBy("name").agg(
        F.max(F.array_max("ids")).alias("keep_id"), F.sum(F.size("ids")).cast("long").alias("group_size")
    )
    # Written, so that the join has a plain exchange on both sides and can split a hot name.
    groups = written(groups, "text-groups")
    found = named.join(groups, "name").select(
        F.explode("ids").alias(id_col),
        "keep_id",
        "group_size",
        F.lower(F.hex(F.substring("name", 1, 32))).alias("text_sha256"),
    )
    return found.select(
        id_col, "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col(id_col)).alias("kept"), "text_sha256"
    )
