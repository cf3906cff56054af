"""Quality by Bradley-Terry ranking of documents from preference pairs.

A good document is preferred to a bad one. The worth of a document is linear in features
of its text; the chance that one is preferred is the logistic function of the difference
of worths, so the weights are those of a logistic loss on feature differences. Pairs are
drawn from labelled training documents, every one of which is in several. The worth at the
quantile of the training texts that are bad becomes the threshold score, 0.3.

Defined results: a null text counts as empty and is scored like any other; rows with a
null or repeated id are scored each; null labels and labels of no document teach nothing;
without both labels in the training texts all scores are equal. Only the named columns are
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.logistic import fit_logistic

TRAIN_ROWS = 200_000
PAIRS_EACH = 4
THRESHOLD = 0.3
NAMES = (
    "log words", "upper", "punctuation", "digits", "word length", "distinct words", "repeated next", "repeated lines",
    "lone signs", "long signs", "word length spread", "line length",
)
_CLASS = np.zeros(256, np.int64)
_CLASS[[c for c in range(128) if chr(c).isupper()]] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
_CLASS[[c for c in range(128) if chr(c).isdigit()]] = 3
_CLASS[[ord(c) for c in "#$%&*|~^_=+<>{}[]\\"]] = 4
_CLASS[list(range(128, 192))] = 5  # all but the first byte of a character


def features(text: str) -> list[float]:
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6)
    chars = max(1, len(data) - int(kinds[5]))
    sizes = np.fromiter(map(len, words), np.int64, n)
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    lines = [x for x in data.split(b"\n") if x.strip()]
    # Distinct words fall with length by nature; measure the share within stretches.
    step = 200
    distinct = sum(len(set(words[k : k + step])) for k in range(0, n, step)) / n
    share = float(kinds[2] + kinds[4]) / chars
    return [
        math.log1p(n) / 10,
        float(kinds[1]) / chars,
        share,
        float(kinds[3]) / chars,
        math.log(float(sizes.mean())),
        distinct,
        same / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float((sizes == 1).mean()),
        float(kinds[4]) / chars,
        math.log1p(float(sizes.std())),
        math.log1p(n / max(1, len(lines))) / 10,
    ]


def _bent(x: np.ndarray) -> np.ndarray:
    """Features with their distance from the usual, so that too little and too much can both be bad."""
    return np.concatenate([x, np.abs(x)], axis=1)


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -12, 12)
        return _bent(z) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``THRESHOLD`` where the worth is the threshold's."""
        z = (self.worth(x) - self.threshold) * self.scale + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights that make the better of each pair likelier, by the logistic loss."""
    return fit_logistic(better - worse, np.ones(len(better)), penalty)


def learn(x: np.ndarray, labels: np.ndarray, pairs_each: int = PAIRS_EACH, seed: int = 5) -> Model:
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    usual = x[good] if len(good) else x
    centre = np.median(usual, axis=0) if len(usual) else np.zeros(len(NAMES))
    low, high = np.quantile(usual, [0.1, 0.9], axis=0) if len(usual) else (centre, centre)
    spread = np.maximum((high - low) / 2, 1e-3)
    model = Model(centre, spread, np.zeros(2 * len(NAMES)), 0.0, 1.0)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(seed)
    # Every document takes part, the rarer label more often.
    n = pairs_each * max(len(good), len(bad))
    a = np.concatenate([rng.permutation(good) for _ in range(-(-n // len(good)))])[:n]
    b = np.concatenate([rng.permutation(bad) for _ in range(-(-n // len(bad)))])[:n]
    bent = _bent(np.clip((x - centre) / spread, -12, 12))
    weights = bradley_terry(bent[a], bent[b])
    worth = bent @ weights
    # The worth below which as many training texts lie as are bad, moved into the gap
    # between the labels there.
    cut = float(np.quantile(worth, len(bad) / len(labels)))
    below, above = worth[labels == 0], worth[labels == 1]
    below, above = below[below <= cut], above[above >= cut]
    if len(below) and len(above):
        cut = float((below.max() + above.min()) / 2)
    scale = 1.0 / max(1e-6, float(np.median(above) - np.median(below)) / 8) if len(below) and len(above) else 1.0
    return Model(centre, spread, weights, cut, scale)


def _measured(rows: DataFrame, keep: str, kept_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], [keep, "x"])

    return rows.mapInArrow(run, f"`{keep}` {kept_type}, x array<double>")


def fit(texts: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows (text, label) with label 0 or 1.

    At most about ``train_rows`` rows are used, a documented bound on the labelled
    sample; a dozen numbers of each come to the driver.
    """
    rows = texts.filter("label IN (0, 1)").select(F.col("label").cast("int"), F.coalesce("text", F.lit("")).alias("text"))
    measured = _measured(rows, "label", "int")
    total = texts.filter("label IN (0, 1)").count()
    if total > train_rows:
        measured = _measured(rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * train_rows / total)), "label", "int")
    seen = measured.collect()
    if not seen:
        return learn(np.zeros((0, len(NAMES))), np.zeros(0))
    seen.sort()
    return learn(np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, from whole texts."""
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"))
    schema = rows.select(F.col(id_col), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], [id_col, "score"])

    return rows.mapInArrow(run, schema)
