"""Sequence similarity of two strings, the one measure Spark has no expression for."""

from __future__ import annotations

from difflib import SequenceMatcher
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


# Ratios a worker keeps for later batches.
MOST_KEPT = 200_000
_known: dict[tuple[str, str], float] = {}


@F.arrow_udf(DoubleType())
def _ratios(left: pa.Array, right: pa.Array) -> pa.Array:
    """Ratio per pair, once per distinct pair; no ratio where a side is null."""
    pairs = list(zip(left.to_pylist(), right.to_pylist()))
    if len(_known) > MOST_KEPT:
        _known.clear()
    fresh = {p for p in pairs if p not in _known and p[0] is not None and p[1] is not None}
    matcher, previous = SequenceMatcher(None), None
    # The matcher indexes its right string, so equal ones in a row are cheap.
    for a, b in sorted(fresh, key=itemgetter(1)):
        if b != previous:
            matcher.set_seq2(b)
            previous = b
        matcher.set_seq1(a)
        _known[a, b] = matcher.ratio()
    return pa.array(map(_known.get, pairs), pa.float64())


def sequence_ratio(needed: Column, left: Column, right: Column) -> Column:
    """Sequence ratio of two texts, ledger side first; null where it is not needed."""
    return _ratios(F.when(needed, left), F.when(needed, right))


def most_similar(left: Column, right: Column) -> Column:
    """Upper bound of the sequence ratio from the edit distance, without Python."""
    joint = F.length(left) + F.length(right)
    return F.lit(1.0 + 1e-9) - F.levenshtein(left, right) / F.nullif(joint, F.lit(0))


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two word sets; most sets share none, which is cheap to see."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.arrays_overlap(a, b), shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger word set."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when(larger > 0, F.size(F.array_intersect(a, b)) / larger).otherwise(F.lit(0.0))
