import base64
import hashlib
import io

import pyarrow as pa
import pytest

import corpus_pipeline
from ledgerloom.llm import warc

PAGES = "page_id long, url string, html string, bundle string, frame int"


def test_archives_of_odd_rows(spark):
    long = "<p>é</p>" * 200_000
    rows = [
        (1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/\r\nX: y", None), (4, "u v", ""), (5, "c", long),
        (6, "c", long), (None, "n", "<p>x</p>"), (2, None, "<p>x</p>"), (7, "d", "\r\n\r\nWARC/1.1\r\n"), (0, "e", "only"), (0, "e", "only"),
    ]
    pages = spark.createDataFrame([(*r, "b", 1) for r in rows], PAGES)
    found = warc.archived_pages(pages).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        refers = first[html or ""] if i is not None and first[html or ""] < i else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_small_frames_and_bundles_and_single_records(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    index = warc.write(pages, frame_bytes=5000, bundle_bytes=20_000)
    assert index.select("bundle").distinct().count() > 1 and index.agg({"frame": "max"}).collect()[0][0] > 0
    texts = {str(r["page_id"]): r["html"].encode() for r in pages.collect()}
    found = warc.read(index).filter("record_type = 'response'").collect()
    assert all(texts[r["page_id"]] == bytes(r["payload"]) for r in found) and len(found) > 40
    one = warc.read(index.filter("page_id = '7'")).collect()
    assert [r["page_id"] for r in one] == ["7"]


def test_frames_stand_alone_and_the_whole_is_plain_zstandard():
    import zstandard

    out = io.BytesIO()
    bundle = warc.Bundle(out)
    data = [warc.record(str(k), None, b"z" * k, None) for k in range(50)]
    places = [bundle.add(d, 2000) for d in data]
    bundle.close()
    table = warc.SeekTable(pa.BufferReader(out.getvalue()))
    for d, (frame, offset) in zip(data, places):
        assert table.frame(frame)[offset : offset + len(d)] == d
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True) as reader:
        assert reader.read() == b"".join(data)


def test_damaged_payloads_are_found():
    data = warc.record("1", "http://a/", b"payload", None)
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


def test_pipeline_stages(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    from ledgerloom.llm import queries
    from test_duplicates import brute_components, brute_fingerprint, low
    from test_scores import brute_hits

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, sf).select(docs.columns)
        after = {r["doc_id"] for r in kept.collect()}
        if name == "toxicity":
            scores = {r["doc_id"]: r["predicted"] for r in queries.op2_toxicity(spark, sf).collect()}
            assert after == {i for i in before if not scores[i]}
        elif name == "exact_dedup":
            assert after == set({low(t): i for i, t in sorted(before.items())}.values())
        elif name == "near_dedup":
            prints = [(i, brute_fingerprint(t)) for i, t in before.items()]
            assert after == set(brute_components(prints).values())
        else:
            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert after == {i for i, t in before.items() if not brute_hits(t, items)[-1]}
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == after


def test_pipeline_keeps_documents_without_id_or_text(spark, sf, make_docs):
    docs = make_docs([(1, "a plain text of several words here"), (None, "another text with no id at all"), (2, None), (3, "")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    # Null and empty texts are equal to one another.
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "3", "None"]


def test_a_repeated_page_id_with_other_payloads_keeps_each(spark):
    rows = [(3, "A"), (7, "A"), (7, "B"), (4, "C"), (8, "A"), (8, "C"), (8, "C")]
    pages = spark.createDataFrame([(i, "u", h, "b", 1) for i, h in rows], PAGES)
    found = warc.read(warc.write(pages)).collect()
    kinds = sorted((r["page_id"], r["payload_digest"], r["refers_to"] or "") for r in found)
    first = {"A": 3, "B": 7, "C": 4}
    assert kinds == sorted((str(i), warc.digest(h.encode()), "" if first[h] == i else str(first[h])) for i, h in rows)
    assert {bytes(r["payload"]) for r in found if r["payload"] is not None} == {b"A", b"B", b"C"}
