"""Token ids in compressed files, in ascending document order, and back.

Documents are dealt by ranges of their id, so the files in order hold all documents in
order. A file has blocks of the range coder, a table of its documents, an index of its
blocks with checksums, and a footer. Files are written under names no other attempt
uses; only those in the written manifest count, so a task that runs twice does no harm.

Defined results: a null text is an empty document, which has the end id alone; rows with
equal ids follow one another; null ids come first; an empty table gives no file with
documents. Ids must be whole numbers. Only the named columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm import range_coder
from ledgerloom.llm.store import file_system, fresh_folder, written
from ledgerloom.llm.tokens import encoder

MAGIC = b"LLTOKENS"
INDEX = np.dtype([("offset", "<u8"), ("size", "<u4"), ("ids", "<u4"), ("crc", "<u4")])
DOCS = np.dtype([("id", "<i8"), ("has_id", "u1"), ("ids", "<u8")])
FOOTER = struct.Struct("<QQQQI8s")
CHUNK = range_coder.LANES * range_coder.BLOCK
OUT_BYTES = 8 << 20


class Writer:
    """One file of blocks; ids are held until a chunk of blocks is full."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0
        self.docs: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.held: list[bytes] = []
        self.size = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids) // 4
        if self.size >= CHUNK:
            self._flush(self.size // range_coder.BLOCK * range_coder.BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for k in range(0, n, CHUNK):
            for count, crc, payload in range_coder.encode(ids[k : min(n, k + CHUNK)]):
                self.index.append((self.at, len(payload), count, crc))
                self._put(payload)
        self.held, self.size = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        self._flush(self.size)
        tables = np.array(self.docs, DOCS).tobytes(), np.array(self.index, INDEX).tobytes()
        places = self.at, self.at + len(tables[0])
        for table in tables:
            self._put(table)
        crc = zlib.crc32(tables[0] + tables[1])
        self._put(FOOTER.pack(places[0], len(self.docs), places[1], len(self.index), crc, MAGIC))


def read_file(stream) -> Iterator[tuple[int | None, bytes]]:
    """(id, ids) of every document of a file, one chunk of blocks at a time."""
    size = stream.size()
    docs_at, n_docs, index_at, n_blocks, crc, magic = FOOTER.unpack(stream.read_at(FOOTER.size, size - FOOTER.size))
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    docs = stream.read_at(n_docs * DOCS.itemsize, docs_at)
    index = stream.read_at(n_blocks * INDEX.itemsize, index_at)
    if zlib.crc32(docs + index) != crc:
        raise ValueError("the tables of a file of token ids do not match their checksum")
    index = np.frombuffer(index, INDEX)
    blocks = _chunks(stream, index)
    held = b""
    for doc_id, has_id, n in np.frombuffer(docs, DOCS).tolist():
        parts, missing = [], 4 * n
        while missing > len(held):
            parts.append(held)
            missing -= len(held)
            held = next(blocks)
        parts.append(held[:missing])
        held = held[missing:]
        yield (doc_id if has_id else None), b"".join(parts)


# Decoded ids are handed on in parts, so that cutting documents off copies little.
PART = 1 << 18


def _chunks(stream, index: np.ndarray) -> Iterator[bytes]:
    for k in range(0, len(index), range_coder.LANES):
        some = index[k : k + range_coder.LANES]
        begin = int(some["offset"][0])
        data = stream.read_at(int(some["offset"][-1]) + int(some["size"][-1]) - begin, begin)
        ids = range_coder.decode(
            [(n, crc, data[at - begin : at - begin + size]) for at, size, n, crc in some.tolist()]
        ).tobytes()
        for at in range(0, len(ids), PART):
            yield ids[at : at + PART]


def write(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all documents; returns the manifest (part, path, n_docs, n_ids, start)."""
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "token-ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")
    last = np.array([end_id], "<u4").tobytes()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        with fs.open_output_stream(f"{root}/{name}", compression=None) as stream:
            writer, total = Writer(stream), 0
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1))):
                    ids += last
                    total += len(ids) // 4
                    writer.add(doc_id, ids)
            writer.close()
        row = {"part": part, "path": f"{folder}/{name}", "n_docs": len(writer.docs), "n_ids": total}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = written(rows.mapInArrow(put, "part long, path string, n_docs long, n_ids long"), "token-manifest")
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the files of a manifest.

    ``start`` counts the ids of all documents before it; ids are little-endian unsigned
    32-bit integers.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = file_system(row["path"])
                at, out, held = row["start"], [], 0
                with fs.open_input_file(path) as stream:
                    for doc_id, ids in read_file(stream):
                        out.append((doc_id, at, ids))
                        at += len(ids) // 4
                        held += len(ids)
                        if held > OUT_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.filter("n_docs > 0").select("part", "path", "start").repartition(parts)
    return files.mapInArrow(get, "doc_id long, start long, ids binary")


def token_file_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the documents, read the files back, and describe every document's ids."""
    return read(write(docs, tokenizer, end_id)).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
