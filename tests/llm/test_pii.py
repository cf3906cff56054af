import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute_base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def in_words(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def parsed(spans):
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]


def check(rows, texts):
    assert len(rows) == len(texts)
    want = sorted(((i, hashlib.sha256(in_words(brute_base(t)).encode()).hexdigest()) for i, t in texts), key=str)
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in rows), key=str) == want


@pytest.fixture(scope="module")
def noisy():
    rnd = random.Random(4)
    signs = ["@", ".", "+", "1", "23", "4111111111111111", " ", "-", "é", "🙂", "a", "b.c", "255", "300", "\n", "(", ")", "(at)", "(dot)", "0"]
    return [(i, "".join(rnd.choice(signs) for _ in range(rnd.randrange(60)))) for i in range(600)]


def test_base_spans_equal_plain_search(spark, make_docs, odd_rows, noisy, monkeypatch):
    odd = [
        (700, "x" * 40_000 + "@" + "b." * 20_000 + "c"), (701, "1" * 50_000), (702, "1." * 20_000 + "2"), (703, "+1" + " (" * 20_000),
        (704, "a@b.c_d@e.f a@b.c@d.e"), (705, "1.2.3.4.5 001.002.003.0004 1.2.3.256 99999999999999999999.1.1.1"), (706, "a@b..c a@b.c. é🙂x@y.z"),
        (707, "4111 1111-1111 1111 2 4111-1111-1111-1111"), (707, "4111 1111-1111 1111 2 4111-1111-1111-1111"), (707, "+49 (30) 123-4567"),
    ]
    rows = [*odd_rows, *noisy, *odd]
    monkeypatch.setattr(queries, "_table", lambda *_: make_docs(rows))
    check(queries.op11_pii(spark, "").collect(), rows)
    monkeypatch.setattr(queries, "_table", lambda *_: make_docs(rows).limit(0))
    assert queries.op11_pii(spark, "").count() == 0


def test_query_keeps_base_spans_and_counts(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op11_pii(spark, sf).collect()
    check(rows, texts)
    base = {i: brute_base(t) for i, t in texts}
    for r in rows:
        spans = parsed(r["spans"])
        assert set(base[r["doc_id"]]) <= set(spans)
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in base[r["doc_id"]]) for k in PATTERNS]


def learnt(n=300):
    """Texts that teach what cards and telephone numbers look like, and numbers that are neither."""
    rnd = random.Random(2)
    told = ("pay with", "call", "part", "there was")
    out = []
    for i in range(n):
        card = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if luhn(card + c))
        other = "9" + "".join(rnd.choice("0123456789") for _ in range(15))
        phone = f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
        parts = [f"{rnd.choice(told)} {card} now", f"{rnd.choice(told)} {phone} now", f"{rnd.choice(told)} {other} now", f"mail a{i}.b@mail{i % 7}.example.com now"]
        rnd.shuffle(parts)
        out.append((i, rnd.choice([" ", ", and on ", " then at last one may well "]).join(parts)))
    return out


def test_what_the_base_rules_miss_is_added(spark, make_docs):
    missed = [
        (1000, "pay with 4111111111111112 now"),  # a digit mistyped
        (1001, "call +1 (405) 555-8253 4909629000452649 now"),  # one number runs into the next
        (1002, "call (405) 555-8253 now"),
        (1003, "mail jane.doe (at) mail5 (dot) example (dot) com now"),
        (1004, "part 9411111111111112 now"),
        (1005, "only words"),
    ]
    found = {r["doc_id"]: r for r in pii.personal_spans(make_docs(learnt() + missed)).collect()}
    texts = dict(missed)

    def said(i):
        return [(s["kind"], texts[i][s["start"] : s["end"]]) for s in found[i]["spans"]]

    assert said(1000) == [("card", "4111111111111112")]
    assert said(1001) == [("card", "4909629000452649"), ("phone", "+1 (405) 555-8253")]
    assert said(1002) == [("phone", "(405) 555-8253")]
    assert said(1003) == [("email", "jane.doe (at) mail5 (dot) example (dot) com")]
    assert said(1004) == [] and said(1005) == []


def test_boosting_fits_an_exclusive_or_and_the_threshold_keeps_precision():
    x = np.array([[a, b] + [0] * 10 for a in range(2) for b in range(2)])
    n = np.full(4, 100.0)
    positive = np.array([0.0, 100, 100, 0]) + np.array([0, 0, 0, 3])
    trees = pii.boost(x, n, positive)
    score = sum(pii._value(t, x) for t in trees)
    assert score[0] < -2 and score[3] < -2 and score[1] > 2 and score[2] > 2
    least = pii.threshold(score, n, positive, 0.9)
    assert (score >= least).tolist() == [False, True, True, False]
    assert pii.threshold(score, n, np.zeros(4), 0.9) == 99.0


def test_scores_in_sql_are_those_of_the_trees(spark, make_docs):
    spans = pii.candidates(make_docs(learnt(60)))
    model = pii.fit(spans)
    rows = spans.select("kind", *pii.FEATURES, model.score().alias("score")).collect()
    assert {r["kind"] for r in rows} >= {"card", "phone", "email"}
    for r in rows:
        x = np.array([[r[f] for f in pii.FEATURES]])
        assert r["score"] == pytest.approx(sum(pii._value(t, x)[0] for t in model.trees[r["kind"]]) if r["kind"] in model.trees else -99.0)


def test_texts_are_redacted(spark):
    rows = spark.createDataFrame(
        [("éa@b.c, +1 22 333 4444!", [(0, 1, 6, "email"), (3, 8, 22, "phone")]), ("12 ab", [(2, 0, 2, "card"), (3, 1, 4, "phone")]), ("", [])],
        "text string, spans array<struct<rank int, start long, end long, kind string>>",
    )
    found = [r[0] for r in rows.select(pii.redacted(F.col("text"), F.col("spans"))).collect()]
    assert found == ["é[EMAIL], [PHONE]!", "[CARD]b", ""]


def test_the_model_counts_every_candidate(spark):
    # Digits alone tell sound candidates from others; only a few texts hold the sound ones.
    rows = spark.range(210_000).select(
        F.col("id").alias("_id"),
        F.md5(F.col("id").cast("string")).alias("_digest"),
        F.lit("phone").alias("kind"),
        (F.col("id") % 3000 == 7).alias("held"),
        *(F.when(F.col("id") % 3000 == 7, 9 if n == "digits" else 0).otherwise(0).alias(n) for n in pii.FEATURES),
    )
    seen = []
    boost, threshold = pii.boost, pii.threshold
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "boost", lambda x, n, positive: seen.append((n.sum(), positive.sum())) or boost(x, n, positive))
        patch.setattr(pii, "threshold", lambda score, n, positive: seen.append((n.sum(), positive.sum())) or threshold(score, n, positive))
        model = pii.fit(rows)
    # Those of four fifths of the texts teach, the others set the threshold.
    assert len(seen) == 2 and np.sum(seen, axis=0).tolist() == [210_000, 70]
    chosen = rows.filter(model.chosen())
    assert chosen.count() == chosen.filter("held").count() == 70
