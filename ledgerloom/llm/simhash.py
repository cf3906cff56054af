"""Near-duplicates by SimHash fingerprints, linked through Golay codewords.

The 64 bits are read as three segments. If two fingerprints differ in at most four bits,
some two segments differ in at most two together (the third has the most errors, and at
least its share), so a point at most one bit from either lies between them. The perfect
(23,12) Golay code maps every segment to one codeword index, so both fingerprints have the
key of that point among the keys of all points within one bit: few, since a flipped bit
leaves most segments with their codeword. Rows with equal keys are verified.

Only distinct fingerprints are keyed. In a task, equal keys are linked as a spanning
forest, never as all pairs; a key with more fingerprints than ``HOT`` is split into
blocks, every two of which meet in one task. Components then join what is linked.

Defined results: null, empty and blank texts have fingerprint zero, linked like any
other; equal texts have equal fingerprints; a null id counts for no component's smallest
id, and a component of nothing but null ids has a null component id; an empty table gives
an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.store import written

SHINGLE = 4
SEED = 42
DISTANCE = 4
WIDTHS = (22, 21, 21)
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0xC75
HOT = 50_000
TEXTS = 256
# Bits of a byte, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    hashed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(hashed[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): the 64 bits as a signed long."""
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"))
    schema = rows.select(F.col(id_col), F.lit(0).cast("long").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few texts at a time become Python strings.
            parts = (batch.column(1).slice(k, TEXTS).to_pylist() for k in range(0, batch.num_rows, TEXTS))
            found = np.array([fingerprint(t) for part in parts for t in part], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [id_col, "fingerprint"])

    return rows.mapInArrow(run, schema)


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the three bytes of a word, and the error of every remainder."""
    bit = []
    for k in range(23):
        word = 1 << k
        for high in range(22, 10, -1):
            if word >> high & 1:
                word ^= GENERATOR << (high - 11)
        bit.append(word)
    byte = np.zeros((3, 256), np.int64)
    for k in range(23):
        byte[k // 8][(np.arange(256) >> (k % 8) & 1).astype(bool)] ^= bit[k]
    error = np.zeros(2048, np.int64)
    for a in range(23):
        error[bit[a]] = 1 << a
        for b in range(a):
            error[bit[a] ^ bit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[bit[a] ^ bit[b] ^ bit[c]] = 1 << a | 1 << b | 1 << c
    return byte, error


def codeword_index(word: np.ndarray) -> np.ndarray:
    """Twelve information bits of the only codeword within three bits of each 23-bit word."""
    byte, error = _golay()
    rest = byte[0][word & 255] ^ byte[1][word >> 8 & 255] ^ byte[2][word >> 16]
    return (word ^ error[rest]) >> 11


def keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): every distinct key of each signed fingerprint."""
    bits = found.view(np.uint64)
    near, at = [], 0
    for width in WIDTHS:
        segment = (bits >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)
        at += width
        # Column 0: the segment itself; then each of its bits flipped.
        flips = np.r_[0, 1 << np.arange(width)]
        near.append(codeword_index(segment[:, None] ^ flips[None, :]))
    rows, out = [], []
    for p, (i, j) in enumerate(PAIRS):
        made = np.concatenate([near[i] << 12 | near[j][:, :1], near[i][:, :1] << 12 | near[j]], axis=1)
        made.sort(axis=1)
        new = np.ones(made.shape, bool)
        new[:, 1:] = made[:, 1:] != made[:, :-1]
        row, _ = np.nonzero(new)
        rows.append(row)
        out.append(made[new] | p << 24)
    return np.concatenate(rows), np.concatenate(out)


def forest(members: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join all fingerprints within ``distance`` bits through one another."""
    rest = members.view(np.uint64)
    while rest.size:
        queue, rest = [rest[:1]], rest[1:]
        while queue and rest.size:
            some = queue.pop()
            for k in range(len(some)):
                if not rest.size:
                    break
                close = np.bitwise_count(rest ^ some[k]) <= distance
                if close.any():
                    reached, rest = rest[close], rest[~close]
                    yield np.full(len(reached), some[k]).view(np.int64), reached.view(np.int64)
                    queue.append(reached)


class _Union:
    """Local components, so that a task hands on one link per fingerprint."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def links(distinct: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(a, b) links between the fingerprints of a table of distinct ones.

    The fingerprints joined through these links are those joined through all pairs
    within ``distance`` bits.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy()
            row, key = keys(found)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(found[row])], ["key", "fingerprint"])

    keyed = distinct.select("fingerprint").mapInArrow(emit, "key long, fingerprint long")
    large = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot), "hot-keys")
    if large.isEmpty():
        block = keyed.withColumn("block", F.lit(0).cast("long"))
    else:
        # Blocks of a large key; every two of them meet under a number of their own.
        parts = F.ceil(F.col("n") / hot)
        own = F.pmod(F.xxhash64("fingerprint"), parts)
        other = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1)))
        block = keyed.join(large, "key", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
        pair = F.least("own", "other") * 1_000_003 + F.greatest("own", "other")
        block = block.select("key", "fingerprint", pair.alias("block"))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = block.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "fingerprint")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = _Union()
        held: list[np.ndarray] = [np.zeros((3, 0), np.int64)]

        def runs(rows: np.ndarray) -> None:
            if not rows.shape[1]:
                return
            starts = np.flatnonzero(np.r_[True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)])
            ends = np.r_[starts[1:], rows.shape[1]]
            size = ends - starts
            two = starts[size == 2]
            a, b = rows[2][two], rows[2][two + 1]
            close = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= distance
            for x, y in zip(a[close].tolist(), b[close].tolist()):
                union.join(x, y)
            many = size > 2
            for s, e in zip(starts[many].tolist(), ends[many].tolist()):
                for x, y in forest(rows[2][s:e], distance):
                    for p, q in zip(x.tolist(), y.tolist()):
                        union.join(p, q)

        for batch in batches:
            rows = np.stack([batch.column(n).to_numpy() for n in ("key", "block", "fingerprint")])
            if not rows.shape[1]:
                continue
            same = (held[0][:2, -1:] == rows[:2, -1:]).all()
            if held[0].size and same:
                held.append(rows)  # one run so far
                continue
            rows = np.concatenate([*held, rows], axis=1)
            # The last run may go on in the next batch.
            before = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0))
            cut = int(before[-1]) + 1 if before.size else 0
            runs(rows[:, :cut])
            held = [rows[:, cut:]]
        runs(np.concatenate(held, axis=1))
        found = [(x, union.find(x)) for x in list(union.parent)]
        found = [(x, r) for x, r in found if x != r]
        for k in range(0, len(found), 100_000):
            a, b = zip(*found[k : k + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id): the smallest id that links of at most ``distance`` bits reach."""
    if distance > DISTANCE:
        raise ValueError(f"the keys find links of at most {DISTANCE} bits")
    found = written(fingerprints(docs, id_col, text_col), "fingerprints")
    first = written(found.groupBy("fingerprint").agg(F.min(id_col).alias("_first")), "distinct-fingerprints")
    roots = components(links(first, distance))
    rooted = written(roots.select(F.col("vertex").alias("fingerprint"), "root").join(first, "fingerprint"), "linked-fingerprints")
    smallest = written(rooted.groupBy("root").agg(F.min("_first").alias("_smallest")), "component-ids")
    linked = rooted.join(smallest, "root").select("fingerprint", "_smallest")
    known = written(
        first.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("_smallest", "_first").alias("component_id")),
        "fingerprint-components",
    )
    return found.join(known, "fingerprint").select(id_col, "fingerprint", "component_id")


def fingerprint_text(fingerprint: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
