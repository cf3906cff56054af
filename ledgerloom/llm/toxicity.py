"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding maps look-alike letters and digits that stand for letters to plain ones, so that
spelling tricks meet the lexicon. The lexicon is learnt from labelled training texts:
words and beginnings of words that toxic texts have far more often than others. A
pattern's weight is the lower end of the interval of its log odds, so that a chance find
weighs nothing. A matching phrase of the exception list is taken out before counting.
The weights found, and their share of the text's words, are calibrated to a score.

Defined results: a null or empty text has no match and gets the score of such texts; rows
with a null or repeated id are scored each; labels that are null, or of no document, teach
nothing; without a toxic training text nothing matches. Only the named columns are read.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.logistic import fit_logistic
from ledgerloom.llm.store import written

# Characters that look like a letter, and signs and digits written for one.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "ո": "n", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
# Phrases that contain a lexicon word and are harmless; matched on folded text.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser")
SHORTEST, LONGEST = 4, 12
LEAST_TEXTS = 3
LEAST_WEIGHT = 1.5
# Errors below its log odds at which a weight is taken.
ERRORS = 1.64
TRAIN_ROWS = 200_000
WORD = re.compile(r"[^\W_]+")
_TABLE = str.maketrans(LOOKALIKES)
# A digit or sign is a letter only next to one: 1diot and id10t, but not 2024 or a price.
_MIXED = re.compile(r"[^\W_]*[0-9@$][^\s]*")


def fold(text: str) -> str:
    """Lower case, look-alikes replaced, and digits inside words read as letters."""
    text = text.lower().translate(_TABLE)
    if not text.isascii():
        text = text.translate(_wide(text))
    if _DIGIT.search(text) is None:
        return text
    return _MIXED.sub(_letters, text)


_DIGIT = re.compile("[0-9@$]")
_LETTERS = str.maketrans(DIGITS)


def _letters(match: re.Match) -> str:
    word = match[0].rstrip("$@")
    if not any(c.isalpha() for c in word):
        return match[0]
    return word.translate(_LETTERS) + match[0][len(word) :]


def _wide(text: str) -> dict[int, str]:
    """Full-width letters to plain ones."""
    return {ord(c): chr(ord(c) - 0xFEE0) for c in set(text) if "！" <= c <= "～"}


@dataclass(frozen=True)
class Model:
    """Weights of patterns (a word ends in a blank, a beginning does not) and the calibration."""

    weights: dict[str, float]
    bias: float
    slopes: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS


@functools.lru_cache(maxsize=2)
def _automaton(patterns: tuple[tuple[str, float], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern, weight in patterns:
        found.add_word(f" {pattern}", (len(pattern) + 1, weight))
    if patterns:
        found.make_automaton()
    return found


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = _automaton(tuple(sorted(model.weights.items())))
        self.exceptions = _automaton(tuple((f"{p} ", 0.0) for p in model.exceptions))

    def features(self, text: str) -> tuple[float, float, float]:
        """Sum of the best weight at each word, its share of the words, and whether any matched."""
        words = WORD.findall(fold(text))
        if not words or not self.model.weights:
            return 0.0, 0.0, 0.0
        line = f" {' '.join(words)} "
        best: dict[int, float] = {}
        for end, (size, weight) in self.automaton.iter(line):
            at = end - size + 1
            if weight > best.get(at, 0.0):
                best[at] = weight
        if best and self.model.exceptions:
            for end, (size, _) in self.exceptions.iter(line):
                for at in [a for a in best if end - size + 1 <= a < end]:
                    del best[at]
        total = sum(best.values())
        return math.log1p(total), math.sqrt(total / len(words)), float(bool(best))

    def score(self, text: str) -> float:
        z = self.model.bias + sum(a * b for a, b in zip(self.model.slopes, self.features(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _terms(text: str) -> set[str]:
    """Folded words (with an end mark) and their beginnings."""
    out = set()
    for word in set(WORD.findall(fold(text))):
        out.add(f"{word} ")
        out.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
    return out


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, other): texts with each term, of rows (text, label), summed before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array([v[1] for v in found.values()], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64())],
                ["term", "toxic", "other"],
            )

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term in _terms(text):
                    found.setdefault(term, [0, 0])[label] += 1
                if len(found) > 500_000:
                    yield flush()
                    found = {}
        if found:
            yield flush()

    counts = rows.select("text", "label").mapInArrow(count, "term string, toxic long, other long")
    return counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def lexicon(counts: DataFrame, toxic: int, other: int) -> dict[str, float]:
    """Patterns and weights: all whose weight is ``LEAST_WEIGHT`` or more, whatever others weigh.

    Every one is in several toxic texts of the bounded training sample, which bounds their number.
    A pattern that a shorter beginning explains as well is left out.
    """
    if not toxic or not other:
        return {}
    a, b = F.col("toxic") + 0.5, F.col("other") + 0.5
    odds = F.log(a / (toxic + 1 - a)) - F.log(b / (other + 1 - b)) if toxic and other else F.lit(0.0)
    error = F.sqrt(1 / a + 1 / b)
    found = (
        counts.filter((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") * other > F.col("other") * toxic))
        .withColumn("weight", odds - ERRORS * error)
        .filter(F.col("weight") >= LEAST_WEIGHT)
        # Shares above one half only: what most texts with the pattern are not is no evidence.
        .filter(F.col("toxic") > F.col("other"))
        .select("term", "weight", "toxic")
    )
    rows = {r["term"]: (r["weight"], r["toxic"]) for r in found.collect()}
    # Of nested patterns with the same toxic texts the longest stands for all: the whole
    # word where it is always that word, else the beginning its forms share.
    longer: dict[str, int] = {}
    for term, (_, texts) in rows.items():
        longer[term[:-1]] = max(texts, longer.get(term[:-1], 0))
    rows = {t: r for t, r in rows.items() if longer.get(t, 0) < r[1]}
    kept: dict[str, float] = {}
    for term in sorted(rows, key=lambda t: (len(t), t)):
        weight, texts = rows[term]
        bare = term.rstrip(" ")
        shorter = [kept[bare[:k]] for k in range(SHORTEST, len(bare) + 1) if bare[:k] in kept]
        if not shorter or weight > max(shorter) + 0.05:
            kept[term] = weight
    return kept


def calibrate(features: np.ndarray, labels: np.ndarray, penalty: float = 0.05) -> tuple[float, tuple[float, ...]]:
    """Bias and non-negative slopes of a logistic fit with a small penalty."""
    x = np.c_[np.ones(len(features)), features]
    free = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[free] = fit_logistic(x[:, free], labels, penalty)
        bad = w < 0
        bad[0] = False
        if not bad.any():
            return float(w[0]), tuple(float(v) for v in w[1:])
        free &= ~bad


def fit(texts: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows (text, label) with label 0 or 1.

    The lexicon counts at most about ``train_rows`` rows and the calibration as many,
    a documented bound on the labelled sample; all are taken when there are fewer.
    """
    rows = texts.filter("label IN (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int"))
    total = rows.count()
    if total > train_rows:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * train_rows / total))
    # Copies of one text are no further evidence.
    rows = written(rows.dropDuplicates(["text", "label"]), "toxicity-training")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = lexicon(term_counts(rows), sizes.get(1, 0), sizes.get(0, 0))
    scorer_model = Model(weights, 0.0, (0.0, 0.0, 0.0), exceptions)
    shared = rows.sparkSession.sparkContext.broadcast(scorer_model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.features(t) for t in batch.column(0).to_pylist()]
            columns = [pa.array(c, pa.float64()) for c in zip(*found)] or [pa.array([], pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["a", "b", "c", "label"])

    # A few numbers per training row, of which there are at most ``train_rows``.
    seen = rows.mapInArrow(measure, "a double, b double, c double, label int").toPandas()
    if not len(seen):
        return scorer_model
    bias, slopes = calibrate(seen[["a", "b", "c"]].to_numpy(), seen["label"].to_numpy(float))
    return Model(weights, bias, slopes, exceptions)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, from whole texts."""
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"))
    schema = rows.select(F.col(id_col), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], [id_col, "score"])

    return rows.mapInArrow(run, schema)


def training(docs: DataFrame, labels: DataFrame, held_out: Column, label: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, label) of the labelled documents that are not held out.

    At most about ``train_rows`` labels take part, chosen by the hash of their id. So the
    labels are small enough to go to the documents, whose texts stay where they are.
    """
    known = labels.filter(~held_out).select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    total = known.count()
    if total > train_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / total))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label")


def is_held_out(modulus: int, remainder: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text has the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))
