"""Ranked lexical search that scores every different bag of words once.

Documents are restricted to the vocabulary of the items. What an item's score can see of a document is
its counts of those terms and its length number m, so documents with the same counts and m form a
class: found by hash, verified by the whole counts. Of a class only the smallest ids can be among the best,
as many as are asked for. Every class is scored once against the items, which go to the
tasks in blocks of bounded size; a task keeps the best classes of each item, and the best
documents follow from these by ascending id.

All numbers are whole but the logarithm in a term's weight.

Defined results: null and empty texts have no terms, count in no statistic and are never found; rows
with equal ids are documents each; a null id comes after all others among equal scores; an item
without terms, or with none that a document has, has no rows; items with equal ids are ranked each
and told apart by their text; empty tables give an empty table. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.store import written

TOP = 10
# Items in a block, and characters of their texts at most: what a task holds of them.
BLOCK_ITEMS = 2_000
BLOCK_CHARS = 16 << 20
# Classes scored side by side.
BATCH = 512
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    """Runs of letters, digits and all that is not ASCII, with A-Z in lower case."""
    return TERM.findall((text or "").translate(_LOWER))


def weight(documents: int, having: int) -> int:
    """A term's weight from the number of documents with terms and of those that have it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def length_number(n, documents, length):
    """m of a document of ``n`` terms."""
    return 25 + (75 * n * documents) // length


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_ITEMS, chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, item, text): items dealt by hash into blocks of at most about ``most`` rows and ``chars`` characters."""
    rows = items.select(F.struct(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).alias("item"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("item.text")), F.lit(0)).alias("c")).collect()[0]
    number = max(1, -(-size["n"] // most), -(-size["c"] // chars))
    return rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(number)))


def bags(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n, bag): number of terms, and pairs (term number, count) of the vocabulary's terms by term number.

    A bag is a string of little-endian 32-bit numbers, so equal bags are equal strings.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(shared.value)}
        for batch in batches:
            sizes, out = [], []
            for text in batch.column(1).to_pylist():
                found = terms(text)
                sizes.append(len(found))
                known = sorted((number[t], c) for t, c in Counter(found).items() if t in number)
                out.append(np.array(known, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["_id", "n", "bag"])

    return rows.mapInArrow(run, f"_id {id_type}, n long, bag binary")


def document_counts(found: DataFrame) -> dict[int, int]:
    """How many documents have each term number, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")[::2]
            here = np.bincount(at, minlength=len(seen))
            here[: len(seen)] += seen
            seen = here
        term = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(seen[term], pa.int64())], ["term", "n"])

    # A row per term of the vocabulary.
    counted = found.select("bag").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.collect()}


def classes(found: DataFrame, documents: int, length: int, top: int = TOP) -> DataFrame:
    """(bag, m, members): every different bag with its length number and the smallest ids that have it."""
    m = F.lit(25).cast("long") + F.expr(f"(75 * n * {documents}L) div {max(1, length)}L")
    rows = found.filter(F.length("bag") > 0).select("_id", "bag", m.alias("m"))
    rows = rows.withColumn("_hash", F.xxhash64("bag", "m"))
    # Rows beyond the first few of a class go before anything is shuffled.
    same = Window.partitionBy("_hash", "bag", "m").orderBy(F.col("_id").asc_nulls_last())
    few = rows.withColumn("_place", F.row_number().over(same)).filter(F.col("_place") <= top)
    members = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_id"))), lambda x: x["_id"])
    return few.groupBy("_hash", "bag", "m").agg(members.alias("members")).drop("_hash")


class Scorer:
    """Scores of classes against the items of a block."""

    def __init__(self, items: list[list[tuple[int, int]]], weights: dict[int, int], terms_known: int):
        self.items = len(items)
        self.weight = np.zeros(terms_known, np.int64)
        self.weight[list(weights)] = list(weights.values())
        at = np.array([(t, i, c) for i, bag in enumerate(items) for t, c in bag], np.int64).reshape(-1, 3)
        at = at[np.argsort(at[:, 0], kind="stable")]
        self.item, self.times = at[:, 1], at[:, 2]
        self.start = np.searchsorted(at[:, 0], np.arange(terms_known + 1))

    def scores(self, bags: list[bytes], m: np.ndarray) -> np.ndarray:
        """Whole-number scores, a row per class and a column per item."""
        sizes = np.fromiter((len(b) // 8 for b in bags), np.int64, len(bags))
        pairs = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2).astype(np.int64)
        row = np.repeat(np.arange(len(bags)), sizes)
        term, count = pairs[:, 0], pairs[:, 1]
        part = self.weight[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[row]))
        out = np.zeros((len(bags), self.items), np.int64)
        order = np.argsort(term, kind="stable")
        term, row, part = term[order], row[order], part[order]
        cuts = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True]) if len(term) else np.zeros(0, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s, e = self.start[term[a]], self.start[term[a] + 1]
            # A class has a term once, and so has an item, so no cell is met twice.
            out[row[a:b, None], self.item[s:e]] += part[a:b, None] * self.times[s:e]
        return out


def _best(scores: np.ndarray, first: list, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """(item, rows): the best classes of each item by score, then by their smallest id."""
    kept = min(top, len(scores))
    least = np.maximum(np.partition(scores, -kept, axis=0)[-kept], 1)
    for i in range(scores.shape[1]):
        rows = np.flatnonzero(scores[:, i] >= least[i])
        if len(rows) > top:
            rows = np.array(sorted(rows.tolist(), key=lambda r: (-scores[r, i], first[r]))[:top])
        if len(rows):
            yield i, rows


def best_classes(bagged: DataFrame, items: list, scorer: dict, top: int = TOP) -> DataFrame:
    """(item, score, members): of each task, the best classes of every item."""
    shared = bagged.sparkSession.sparkContext.broadcast(scorer)
    id_type = bagged.schema["members"].dataType.elementType
    order = bagged.select("bag", "m", "members")

    def key(members) -> tuple:
        return (members[0] is None, members[0] if members[0] is not None else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Scorer(**shared.value)
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                some = batch.slice(at, BATCH)
                bags, members = some.column(0).to_pylist(), some.column(2).to_pylist()
                scores = made.scores(bags, some.column(1).to_numpy())
                first = [key(x) for x in members]
                for i, rows in _best(scores, first, top):
                    held = best.setdefault(i, [])
                    held += [(-int(scores[r, i]), first[r], members[r]) for r in rows.tolist()]
                    held.sort(key=lambda h: h[:2])
                    del held[top:]
        flat = [(i, -s, members) for i, held in best.items() for s, _, members in held]
        if flat:
            item, score, members = zip(*flat)
            kind = pa.list_(batch.schema.field("members").type.value_type)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(members, kind)], ["_item", "score", "members"])

    return order.mapInArrow(run, f"_item int, score long, members array<{id_type.simpleString()}>")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(item id, rank, id, score): for each item the ``top`` documents with the highest scores above nought."""
    spark = docs.sparkSession
    dealt = written(blocks(items, item_id, item_text, block_items), "search-items")
    number = (dealt.agg(F.max("block")).collect()[0][0] or 0) + 1
    item_type = dealt.schema["item"].dataType
    out = None
    for b in range(number):
        asked = sorted((r["item"] for r in dealt.filter(F.col("block") == b).collect()), key=lambda r: (str(r["id"]), r["text"]))
        counts = [Counter(terms(r["text"])) for r in asked]
        vocabulary = sorted(set().union(*counts))
        place = {t: k for k, t in enumerate(vocabulary)}
        found = written(bags(docs, vocabulary, id_col, text_col), "search-bags")
        sums = found.filter("n > 0").agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).collect()[0]
        having = document_counts(found)
        scorer = {
            "items": [sorted((place[t], c) for t, c in bag.items()) for bag in counts],
            "weights": {t: weight(sums["d"], n) for t, n in having.items()},
            "terms_known": len(vocabulary),
        }
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        bagged = written(classes(found, sums["d"], sums["l"], top).repartition(parts, F.xxhash64("bag")), "search-classes")
        best = best_classes(bagged, asked, scorer, top)
        each = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("_doc").asc_nulls_last())
        documents = best.select("_item", "score", F.explode("members").alias("_doc"))
        few = documents.withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= top)
        # The ids of a block, of which there are at most ``block_items``.
        names = spark.createDataFrame([(k, r["id"]) for k, r in enumerate(asked)], f"_item int, _name {item_type['id'].dataType.simpleString()}")
        part = few.join(F.broadcast(names), "_item").select(F.col("_name").alias(item_id), "rank", F.col("_doc").alias(id_col), "score")
        out = part if out is None else out.unionByName(part)
    return out
