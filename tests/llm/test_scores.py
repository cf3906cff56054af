import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

import __spark_entry__ as entry
from ledgerloom.llm import decontam, licenses, quality, toxicity

from compare import differences, duck


def test_fold():
    assert toxicity.fold("IdI0t 1d10t іdіоt $cum 2024 $5") == "idiot idiot idiot scum 2024 $5"
    assert toxicity.fold("ｉｄｉｏｔ") == "idiot"


MODEL = toxicity.Model({"idiot ": 4.0, "trash ": 3.0, "lowei": 5.0}, -4.0, (3.0, 1.0, 1.0))


def test_lexicon_matches_words_and_beginnings():
    found = toxicity.Scorer(MODEL)
    assert found.features("")[0] == found.features("idiotic nontrash xlowei")[0] == 0
    assert found.features("You 1diot!")[2] == 1
    assert found.features("loweischaft")[2] == 1
    assert found.features("put it in the trash can")[2] == 0
    assert found.features("trash, not the trash can")[2] == 1
    one, many = found.features("idiot " + "word " * 10), found.features("idiot " + "word " * 1000)
    assert one[1] > many[1] and one[0] == many[0]


def test_toxicity_learns(spark, make_docs):
    rows = [("some plain words here " * 3, 0)] * 30 + [(f"you idiot number {k}", 1) for k in range(10)] + [(None, 0), ("x", None)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    docs = make_docs([(1, "an id1ot wrote this"), (2, None), (3, ""), (None, "plain words"), (1, "an id1ot wrote this")])
    found = toxicity.score(docs, model).collect()
    assert [r["score"] >= 0.7 for r in found] == [True, False, False, False, True]
    assert all(0 <= r["score"] <= 1 for r in found)
    nothing = toxicity.fit(spark.createDataFrame([], "text string, label int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, nothing).collect())


def test_quality_learns(spark, make_docs):
    rng = random.Random(8)
    words = "some plain words of many kinds and lengths, with a comma here. An ordinary sentence ends so. The next begins".split()
    rows = [(" ".join(rng.choices(words, k=rng.randint(5, 60))), 1) for _ in range(60)]
    rows += [(f"BUY!! NOW!! {k}!! BUY!! NOW!!", 0) for k in range(6)] + [("same " * 40, 0)] * 4 + [(None, None)]
    model = quality.fit(spark.createDataFrame(rows, "text string, label int"))
    docs = make_docs([(1, "Here is an ordinary sentence with several words in it."), (2, "BUY!! IT!! NOW!!"), (None, None), (3, "")])
    found = [r["score"] for r in quality.score(docs, model).collect()]
    assert found[0] >= 0.3 > found[1] and found[2] == found[3] and all(0 <= x <= 1 for x in found)
    nothing = quality.fit(spark.createDataFrame([], "text string, label int"))
    assert len({r["score"] for r in quality.score(docs, nothing).collect()}) == 1


@pytest.mark.parametrize("name, column, least", [("op2_toxicity", "toxic", 0.9), ("op3_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, column, least):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in entry.queries()[name](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 40
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= least * len(rows)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, size=13):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = defaultdict(set)
    for item, body in items:
        w = WORDS.findall(lower(body))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(item or "")
    words = WORDS.findall(lower(text))
    hit, found = [0] * len(words), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            if has := windows.get(tuple(words[k : k + n])):
                found |= has
                hit[k : k + n] = [1] * n
    digest = sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), sum(hit), len(found), digest, bool(sum(hit)) and 20 * sum(hit) >= len(words)


@pytest.mark.parametrize("block_windows", [decontam.BLOCK_WINDOWS, 14])
def test_decontamination_against_brute_force(spark, make_docs, odd_rows, block_windows):
    run = " ".join(f"w{k % 7}" for k in range(40))
    items = [("a", run), ("b", "Short item"), ("b", "Short item"), (None, "w1 w2 w3"), ("d", None), ("e", "!!!"), ("f", "one two " * 9)]
    rows = odd_rows + [(20, run + " tail"), (21, "a SHORT, item"), (22, "w1-w2 w3"), (23, ("pad " * 300) + "short item"), (24, "one two " * 30)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = decontam.judged(decontam.contamination(make_docs(rows), benchmark, block_windows=block_windows)).collect()
    want = [(i, *brute_hits(t, items)) for i, t in rows]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    nothing = decontam.judged(decontam.contamination(make_docs(rows), benchmark.limit(0)))
    assert nothing.filter("contaminated OR n_hit > 0").count() == 0 and nothing.count() == len(rows)
    assert decontam.contamination(make_docs([]), benchmark).count() == 0


def test_filed_under_the_rarest_word():
    index = decontam.filed([("i", "the cat sat")], {b"the": 9, b"cat": 1, b"sat": 4})
    assert index == {b"cat": [(1, (b"the", b"cat", b"sat"), frozenset({"i"}))]}


def test_license_scan(spark, make_docs):
    mit = licenses.KNOWN["MIT"]
    rows = [
        (1, mit),
        (2, "Copyright (c) 2020 Someone\n" + mit.upper().replace("LICENSE", "LICENCE").replace('"', "'")),
        (3, mit + " and more"),
        (4, "text\n  released UNDER the MIT licence\nmore\nAll rights reserved!"),
        (5, None),
        (None, "All rights reserved."),
        (6, "Licensed under the Apache License, Version 2.0."),
        (6, "Licensed under the Apache License, Version 2.0."),
    ]
    found = licenses.scan(make_docs(rows), licenses.known_digests(spark)).collect()
    want = [
        (1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, "MIT notice, Reserved"), (5, None, ""),
        (None, "Reserved", "Reserved"), (6, "Apache-2.0 notice", "Apache-2.0 notice"), (6, "Apache-2.0 notice", "Apache-2.0 notice"),
    ]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert licenses.scan(make_docs([]), licenses.known_digests(spark)).count() == 0


def test_license_scan_has_no_python(spark, documents):
    plan = licenses.scan(documents, licenses.known_digests(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op6_licenses", "op7_exact", "op8_decontam"])
def test_query_equals_sql(spark, sf, name):
    assert differences(spark, duck(sf), sf, entry.queries()[name], entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_queries_return_a_row_for_every_input(spark, sf, name):
    rows = entry.queries()[name](spark, sf)
    table, key = ("pages", "page_id") if name.startswith("op9") else ("documents", "doc_id")
    there = spark.read.parquet(f"{sf}/{table}.parquet")
    assert rows.select(key).distinct().count() == there.count()
    assert rows.count() == there.count() or name == "op1_packing"


def test_calibration_of_separable_labels_comes_to_rest():
    rng = np.random.default_rng(0)
    labels = (rng.random(20_000) < 0.1).astype(float)
    hits = labels * rng.integers(1, 60, 20_000) * 6.0
    found = np.c_[np.log1p(hits), np.sqrt(hits / 300), hits > 0]
    bias, slopes = toxicity.calibrate(found, labels)
    z = bias + found @ np.array(slopes)
    assert np.isfinite(z).all() and ((z > np.log(0.7 / 0.3)) == (labels == 1)).all() and min(slopes) >= 0


def test_items_longer_than_a_block_and_many_small_blocks(spark, make_docs):
    words = [f"w{k % 70}x{k}" for k in range(300)]
    items = [("long", " ".join(words)), ("short", "only four words here"), *((f"i{k}", " ".join(words[k : k + 13])) for k in range(0, 100, 5))]
    docs = [(1, "before " + " ".join(words[40:90]) + " after"), (2, " ".join(words[:12])), (3, "x only four words here y"), (4, " ".join(words))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = decontam.judged(decontam.contamination(make_docs(docs), benchmark, block_windows=20)).collect()
    want = {i: brute_hits(t, items) for i, t in docs}
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == {i: tuple(w) for i, w in want.items()}
    sets = list(decontam.vocabulary_blocks(benchmark, "text", most=50))
    assert len(sets) > 4 and set().union(*sets) == {w.encode() for _, t in items for w in t.split()}


def test_no_pattern_is_dropped_for_its_length_or_for_heavier_ones(spark):
    long = "thisisaveryvileandexceedinglylongword" * 2
    rows = [(f"quite vile talk about nothing {k}", 1) for k in range(300)] + [(f"some {long} here {k}", 1) for k in range(4)]
    rows += [(f"plain harmless talk {k}", 0) for k in range(3000)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    scorer = toxicity.Scorer(model)
    assert scorer.score(f"well {long} again") > 0.3 > 0.01 > scorer.score("plain talk again")


def test_lexicon_scan_equals_a_plain_search():
    rnd = random.Random(5)
    letters = "abаеo0431$ @é.\n"
    patterns = {"abba ": 2.0, "abb": 1.0, "boba ": 3.0, "aeo": 0.5, "ob": 0.25}
    model = toxicity.Model(patterns, 0.0, (1.0, 1.0, 1.0), ("abba boba",))
    scorer = toxicity.Scorer(model)
    seen = 0
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))
        words = toxicity.WORD.findall(toxicity.fold(text))
        taken = {k + d for k in range(len(words) - 1) if words[k] == "abba" and words[k + 1] == "boba" for d in (0, 1)}
        total = 0.0
        for k, w in enumerate(words):
            weights = [x for p, x in patterns.items() if (w == p[:-1] if p.endswith(" ") else w.startswith(p))]
            if weights and k not in taken:
                total += max(weights)
        found = scorer.features(text)
        assert found[0] == pytest.approx(np.log1p(total))
        seen += total > 0
    assert seen > 100
