from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.functions import similarity


def test_a_pair_of_texts_is_compared_once_by_a_worker(monkeypatch):
    left, right = ["coffee shop", None, "gas", "gas", ""], ["coffee bar", "gas", None, "gap", "x"]
    want = [SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else None for a, b in zip(left, right)]
    assert similarity._ratios.func(pa.array(left), pa.array(right)).to_pylist() == want

    class Never(SequenceMatcher):
        def ratio(self):
            raise AssertionError("known from the batch before")

    monkeypatch.setattr(similarity, "SequenceMatcher", Never)
    assert similarity._ratios.func(pa.array(left[::-1]), pa.array(right[::-1])).to_pylist() == want[::-1]
    assert similarity._ratios.func(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []


def test_shared_words_over_all_words(spark):
    rows = [(["a", "b"], ["b", "c"]), (["a"], ["b"]), ([], []), (None, ["a"]), ([""], [""])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    found = [r[0] for r in df.select(similarity.word_jaccard(F.col("a"), F.col("b"))).collect()]
    assert found == [1 / 3, 0.0, 0.0, 0.0, 1.0]
