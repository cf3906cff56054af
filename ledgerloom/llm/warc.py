"""WARC archives as seekable Zstandard bundles, with an index of every record.

A bundle is a file of independent Zstandard frames, each with whole records, and ends in
a skippable frame with a seek table (the public seekable format), so a reader takes a
frame's place from the end of the file and decompresses that frame alone. The index
gives for every page its bundle, frame, and the offset and length inside the frame.

Pages with equal payloads are stored once: the one with the smallest id as response,
the others as revisits that name it.

Defined results: a null payload is empty; empty payloads are equal to one another; rows
that share the smallest id are all responses, and so is a row without id; a null url is
left out; an empty table gives no bundle. Bundles are written under names no other
attempt uses, and only those in the written index count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import file_system, fresh_folder, written

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the seekable format and of WARC.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "page_id string, bundle string, frame int, offset long, length long"
INDEX_ARROW = pa.schema(
    [("page_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit has the response's HTTP header but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=URI_SAFE)}")
    head += [
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


URI_SAFE = "%:/?#[]@!$&'()*+,;=-._~"


def _urn(page_id: str | None) -> str:
    return f"<urn:page:{'' if page_id is None else quote(page_id, safe='')}>"


def _page(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) or None if urn else None


def parse(data: bytes) -> dict:
    """Fields of a record; the digest of a stored payload is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, found = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != found):
        raise ValueError("a payload does not match its digest")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "record_type": kind,
        "refers_to": _page(fields.get("WARC-Refers-To")),
        "payload_digest": found,
        "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


class Bundle:
    """A file of frames that ends in their seek table."""

    def __init__(self, stream, level: int = LEVEL):
        import zstandard

        self.stream = stream
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.stored = 0

    def add(self, data: bytes, frame_bytes: int = FRAME_BYTES) -> tuple[int, int]:
        """The record's frame and its offset there."""
        if self.size and self.size + len(data) > frame_bytes:
            self.flush()
        place = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        packed = self.compressor.compress(b"".join(self.held))
        self.stream.write(packed)
        self.frames.append((len(packed), self.size))
        self.stored += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class SeekTable:
    """Frames of an open bundle, from the table at its end."""

    def __init__(self, stream):
        import zstandard

        self.stream, size = stream, stream.size()
        n, _, magic = struct.unpack("<IBI", stream.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("a bundle has no seek table")
        table = stream.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, raw in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, raw))
            at += packed
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, raw = self.frames[number]
        return self.decompressor.decompress(self.stream.read_at(packed, at), max_output_size=raw)


def revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int = 0) -> DataFrame:
    """(id, sha, refers_to) of pages whose payload another page with a smaller id has.

    Only digests are moved; groups are counted before the shuffle.
    """
    payload = F.coalesce(html_col, F.lit(""))
    small = pages.select(F.col(id_col).alias("_id"), F.sha2(payload, 256).alias("_sha")).filter(F.octet_length(payload) >= min_bytes)
    first = small.groupBy("_sha").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first < _last")
    found = small.join(first.drop("_last"), "_sha").filter("_id > _first")
    return found.select("_id", "_sha", F.col("_first").cast("string").alias("_refers_to")).distinct()


def write(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write all pages into bundles; returns the index (page_id, bundle, frame, offset, length)."""
    folder = folder or fresh_folder(pages.sparkSession, "warc")
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(html_col, F.lit("")).alias("_html")
    )
    # An id may be that of several payloads, so the payload takes part.
    rows = rows.withColumn("_sha", F.sha2("_html", 256)).join(revisits(pages, id_col, html_col, min_bytes), ["_id", "_sha"], "left")
    rows = rows.select(F.col("_id").cast("string"), "_url", "_html", "_refers_to")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        records = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        row = next(records, None)
        while row is not None:
            name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            index = []
            with fs.open_output_stream(f"{root}/{name}", compression=None) as stream:
                bundle = Bundle(stream)
                while row is not None and bundle.stored < bundle_bytes:
                    page_id, url, html, refers_to = row
                    data = record(page_id, url, html.encode(), refers_to)
                    frame, offset = bundle.add(data, frame_bytes)
                    index.append((page_id, f"{folder}/{name}", frame, offset, len(data)))
                    row = next(records, None)
                bundle.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), INDEX_ARROW.types)], schema=INDEX_ARROW)

    return written(rows.mapInArrow(put, INDEX_SCHEMA), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Records at the places of an index, or of any part of it.

    Frames are dealt evenly over tasks, and each is decompressed once.
    """
    schema = pa.schema(
        [("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
         ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    )

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = table = number = data = stream = None
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if stream is not None:
                        stream.close()
                    name, number = row["bundle"], None
                    fs, path = file_system(name)
                    stream = fs.open_input_file(path)
                    table = SeekTable(stream)
                if row["frame"] != number:
                    number = row["frame"]
                    data = table.frame(number)
                found = parse(data[row["offset"] : row["offset"] + row["length"]])
                if found["page_id"] != row["page_id"]:
                    raise ValueError("the index points at another record")
                out.append(found)
                held += row["length"]
                if held > 8 * FRAME_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if stream is not None:
            stream.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = index.repartition(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return places.mapInArrow(
        get, "page_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
    )


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back, and describe every record."""
    kind = pages.schema["page_id"].dataType
    found = read(write(pages))
    return found.select(
        F.col("page_id").cast(kind),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind),
    )
