"""Benchmark decontamination by a prefix-filtered set join.

An item is read as windows of consecutive words, a short item as one window. A document
contains a window only if it contains the window's rarest word, so that word alone is
joined: words are ordered by the number of documents that have them, counted over all
documents, and every window is filed under its rarest word with the word's place in it.
A document is looked up word by word; where a filed word occurs, the place gives the
only position the window can have. Windows that would begin before the first or end
behind the last word are skipped, the others are compared word by word.

The filed windows go to all tasks in blocks of at most about ``BLOCK_WINDOWS``, some 450 bytes
each in a worker; documents pass all blocks in one scan. Words are counted in one scan
before, for ``BLOCK_WORDS`` words of the benchmark at a time.

Defined results: null texts have no words; an item without words has no window; items with
equal ids count once, a null item id counts as the empty string; ids of documents may be null
or repeated; an empty benchmark contaminates nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
BLOCK_WINDOWS = 250_000
BLOCK_WORDS = 1_000_000
# ASCII letters and digits, after lower-casing, and every other character.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


def item_windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_windows: int, size: int = WINDOW) -> Iterator[list[tuple[str, str]]]:
    """Items in lists of at most ``block_windows`` words, so of no more windows, one list on the driver at a time.

    An item beyond that comes in parts that overlap by a window less one word; parts keep their id.
    """
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text_col, F.lit("")))
    block, held = [], 0
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        step = max(size, block_windows)
        for at in range(0, max(1, len(words) - size + 1), step):
            part = words[at : at + step + size - 1]
            if block and held + len(part) > block_windows:
                yield block
                block, held = [], 0
            block.append((item, b" ".join(part).decode()))
            held += len(part)
    if block:
        yield block


def vocabulary_blocks(benchmark: DataFrame, text_col: str, most: int = BLOCK_WORDS) -> Iterator[set[bytes]]:
    """The different words of a benchmark in sets of about ``most``, dealt by hash."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w for text in batch.column(0).to_pylist() for w in words_of(text)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], ["word"])

    words = benchmark.select(text_col).mapInArrow(distinct, "word binary").distinct()
    blocks = max(1, -(-words.count() // most))
    for k in range(blocks):
        yield {bytes(r["word"]) for r in words.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k).collect()}


def word_rarity(docs: DataFrame, vocabulary: set[bytes], text_col: str) -> dict[bytes, int]:
    """In how many documents each word of a block occurs; at most as many numbers as it has words."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found = shared.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(wanted.intersection(words_of(text)))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
            )

    partial = docs.select(text_col).mapInArrow(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in partial.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def filed(items: list[tuple[str, str]], rarity: dict[bytes, int], size: int = WINDOW) -> dict[bytes, list]:
    """Rarest word -> (place in the window, window, items that have it)."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        for window in item_windows(words_of(text), size):
            owners[window].add(item)
    out = defaultdict(list)
    for window, has in owners.items():
        rare = min(window, key=lambda w: (rarity.get(w, 0), w))
        out[rare].append((window.index(rare), window, frozenset(has)))
    return dict(out)


def hits_of(words: list[bytes], index: dict[bytes, list]) -> tuple[list[tuple[int, int]], set[str]]:
    """Ranges of words inside windows, merged, and the items whose windows occur."""
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    if index.keys().isdisjoint(words):
        return ranges, items
    n = len(words)
    for at, word in enumerate(words):
        entries = index.get(word)
        if entries is None:
            continue
        for place, window, has in entries:
            begin = at - place
            end = begin + len(window)
            if begin >= 0 and end <= n and tuple(words[begin:end]) == window:
                ranges.append((begin, end))
                items |= has
    return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = out[-1][0], end
        else:
            out.append((begin, end))
    return out


NONE = "CAST(array() AS array<struct<begin:bigint,end:bigint>>) AS ranges", "CAST(array() AS array<string>) AS items"
RANGES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def add_hits(rows: DataFrame, index: dict[bytes, list]) -> DataFrame:
    """Adds what a block finds to the ``ranges`` and ``items`` of rows (id, text, n_words, ranges, items)."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ranges, items = [], [], []
            before = zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)))
            for text, known, has in before:
                words = words_of(text)
                found, more = hits_of(words, shared.value)
                counts.append(len(words))
                if known and found:
                    found = merged([(r["begin"], r["end"]) for r in known] + found)
                    known = None
                ranges.append(known or [{"begin": b, "end": e} for b, e in found])
                items.append([*has, *more])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(ranges, RANGES), pa.array(items, pa.list_(pa.string()))],
                batch.schema.names,
            )

    return rows.mapInArrow(search, rows.schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """(id, n_words, ranges, items) of every row: hit ranges of words, and items, sorted as strings.

    Documents pass all blocks one after another; nothing of them is shuffled.
    """
    text = F.col(text_col).alias("_text")
    rows = docs.select(F.col(id_col), text).selectExpr("*", "0L AS n_words", *NONE)
    empty = True
    rarity: dict[bytes, int] = {}
    for vocabulary in vocabulary_blocks(benchmark, item_text_col):
        rarity |= word_rarity(docs, vocabulary, text_col)
    for block in blocks_of(benchmark, item_col, item_text_col, block_windows, size):
        index = filed(block, rarity, size)
        rows, empty = add_hits(rows, index), False
    if empty:
        rows = add_hits(rows, {})
    return rows.select(id_col, "n_words", "ranges", F.array_sort(F.array_distinct("items")).alias("items"))


def judged(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Contract columns: hit words, items and their digest, and whether a twentieth is hit."""
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["begin"])
    rows = found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
    )
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
