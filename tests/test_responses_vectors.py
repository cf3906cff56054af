import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import responses, vectors

CASES = [
    ("a", 'Here: [{"date":"2024-01-05","amount":"12.5","vendor":"A","description":"d"}] ok', 1, 1),
    ("b", '[{"amount":true,"vendor":null},"x",5]', 1, 0),
    ("c", '[{"amount":"bad","vendor":"q"},{"vendor":"z"},{"amount":1e2,"vendor":7}]', 1, 0),
    ("d", "[]", 0, 0),
    ("e", "no brackets", 0, 0),
    ("f", "] [", 0, 0),
    ("g", '[{"a":1},]', 0, 0),
    ("h", '[{"date":"d","amount":1,"vendor":"Joe LLC","description":"x","type":null}]', 1, 0),
    ("i", '[{"date":"d","amount":"1_000","vendor":"Joe LLC","description":"x","type":" Credit "}]', 1, 1),
]


def test_response_rules(spark):
    df = spark.createDataFrame([(k, t) for k, t, _, _ in CASES], "filename string, response string")
    for rules, place in (("deployed", 2), ("strict", 3)):
        found = {r.filename: r["count"] for r in responses.parse_responses(df, rules).groupBy("filename").count().collect()}
        assert found == {c[0]: c[place] for c in CASES if c[place]}
    strict = {r.filename: r for r in responses.parse_responses(df, "strict").collect()}
    assert (strict["i"].vendor, strict["i"].type, strict["i"].amount) == ("Joe", "credit", 1000.0)
    assert strict["a"].type == "debit" and strict["a"].source == "image_extraction"
    with pytest.raises(ValueError):
        responses.parse_responses(df, "other")


def test_extractor_hook(spark):
    images = spark.createDataFrame([("a.png", "QUJD")], "filename string, image_base64 string")

    def fake(batches):
        for batch in batches:
            yield pd.DataFrame(
                {"session_id": "s", "filename": batch["filename"], "response": '[{"amount": 2, "vendor": "V"}]'}
            )

    out = responses.extract_responses(images, fake, "session_id string, filename string, response string")
    env = responses.extraction_envelope(out).first()
    assert (env.status, env.total_transactions) == ("success", 1)


def test_cosine_top_k(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [0.6, 0.8])]
    index = spark.createDataFrame(rows, "doc_id long, embedding array<float>").withColumn(
        "text", F.concat(F.lit("t"), F.col("doc_id").cast("string"))
    ).withColumn("amount", F.lit(2.5))
    query = F.array(F.lit(1.0), F.lit(0.0))
    found = vectors.similar_transactions(index, query).collect()
    assert [r.doc_id for r in found] == [2, 1, 5]
    context = vectors.retrieval_context(vectors.similar_transactions(index, query), n=2).first()
    assert (context.context, context.matching_transactions, context.total_amount) == ("t2\nt1", 3, 7.5)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, vector array<double>")
    batch = vectors.similar_batch(index, asked).collect()
    assert [(r.query_id, r.doc_id) for r in sorted(batch, key=lambda r: r["rank"])] == [("q", 2), ("q", 1), ("q", 5)]
    many = spark.createDataFrame([(str(k), [1.0, 0.0]) for k in range(7)], "query_id string, vector array<double>")
    blocks = vectors.similar_batch(index, many, k=1, block=2).collect()
    assert sorted((r.query_id, r.doc_id) for r in blocks) == [(str(k), 2) for k in range(7)]


def test_hashed_embedding_is_deterministic(spark):
    df = spark.createDataFrame([("red gizmo",), ("red gizmo",), (None,)], "text string")
    a, b, c = (r.embedding for r in vectors.embed_text(df).collect())
    assert a == b and sum(x * x for x in a) == pytest.approx(1.0) and not any(c)


def test_custom_encoder(spark):
    df = spark.createDataFrame([("abc",)], "text string")
    out = vectors.embed_text(df, lambda c: F.array(F.length(c).cast("float")))
    assert out.first().embedding == [3.0]
