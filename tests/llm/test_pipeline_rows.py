from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import queries, toxicity

CLEAN = "a plain text of some harmless words about rivers and bridges"


def texts(found):
    return sorted((str(r["doc_id"]), r["text"]) for r in found.collect())


def test_a_toxic_row_goes_alone_and_also_without_id(spark, make_docs, monkeypatch):
    monkeypatch.setattr(queries, "toxicity_model", lambda *_: toxicity.Model({"vileword ": 5.0}, -5.0, (20.0, 0.0, 0.0), ()))
    docs = make_docs([(1, CLEAN), (1, "vileword here"), (None, "vileword there"), (None, CLEAN)])
    assert texts(corpus_pipeline.drop_toxic(spark, docs, "")) == [("1", CLEAN), ("None", CLEAN)]


def test_one_of_equal_rows_stays_and_other_texts_of_its_id(spark, make_docs):
    other = "something else entirely, with no word in common"
    docs = make_docs([(1, CLEAN), (2, CLEAN), (2, CLEAN), (1, other), (None, CLEAN), (None, "twice"), (None, "twice")])
    want = [("1", other), ("2", CLEAN), ("None", "twice")]
    assert texts(corpus_pipeline.drop_exact_copies(spark, docs, "")) == want
    # Of near copies, the smallest id.
    want = [("1", CLEAN), ("1", other), ("None", "twice")]
    assert texts(corpus_pipeline.drop_near_copies(spark, docs, "")) == want


def test_a_contaminated_row_goes_alone_and_also_without_id(spark, sf, make_docs):
    item = max((r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    docs = make_docs([(1, CLEAN), (1, item), (None, item), (None, CLEAN)])
    assert texts(corpus_pipeline.drop_contaminated(spark, docs, sf)) == [("1", CLEAN), ("None", CLEAN)]


def test_columns_named_like_the_stages_own_stay(spark, sf, make_docs, monkeypatch):
    monkeypatch.setattr(queries, "toxicity_model", lambda *_: toxicity.Model({"vileword ": 5.0}, -5.0, (20.0, 0.0, 0.0), ()))
    names = ("_stage_row", "order", "row", "digest", "component_id", "fingerprint", "kept")
    docs = make_docs([(1, CLEAN), (2, CLEAN), (3, "vileword"), (None, "other words"), (4, None)])
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    rows = docs.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["2", "4", "None"]
    assert all([r[n] for n in names] == list(range(len(names))) for r in rows)


def test_near_copies_leave_the_smallest_id(spark, make_docs):
    words = [f"word{k}" for k in range(8000)]
    edited = [*words[:200], "edited", *words[201:]]
    rows = [(5, " ".join(edited)), (3, " ".join(words)), (3, " ".join(reversed(words))), (None, " ".join(words)), (8, CLEAN)]
    kept = texts(corpus_pipeline.drop_near_copies(spark, make_docs(rows), ""))
    assert kept == sorted([("3", rows[1][1]), ("3", rows[2][1]), ("8", CLEAN)])
