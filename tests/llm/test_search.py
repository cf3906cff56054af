import math
import random
import re
import sys
from collections import Counter

import numpy as np

from ledgerloom.llm import queries, search

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from compare import differences, duck  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, top=10):
    """Every document against every item."""
    bags = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    length = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            score = 0
            m = 25 + (75 * sum(b.values()) * n_docs) // max(1, length)
            for t in TERM.findall(low(text)):
                if t in b:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda f: f[:3])
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(found[:top])]
    return sorted(out, key=str)


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_terms():
    assert search.terms("Ab-cÉ, 1_2 x\x7fy{z}漢字 [q] @I`") == ["ab", "cÉ", "1", "2", "x", "y", "z", "漢字", "q", "i"]
    assert search.terms(None) == [] and search.terms("...") == []


def test_odd_rows_and_ties_and_classes(spark, make_docs, odd_rows):
    rnd = random.Random(6)
    words = "a b c dd ee ff É 12 zz".split()
    docs = [*odd_rows]
    for i in range(100, 400):
        docs.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(6)))))
    docs += [(rnd.randrange(400, 480), "A dd, dd ff") for _ in range(150)] + [(None, "ee ee ff")] * 12
    items = [(1, "a B dd dd"), (2, "nothing of this, qqqq"), (3, None), (4, ""), (5, "One text word3 of7 漢字"), (6, "ee ff ff É"), (None, "zz 12")]
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id int, text string, block string, score int")
    found = search.ranked(make_docs(docs), asked)
    assert rows_of(found) == brute(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    # In small blocks, and for other depths.
    assert rows_of(search.ranked(make_docs(docs), asked, block_items=2, top=3)) == brute(docs, items, 3)
    assert search.ranked(make_docs(docs).limit(0), asked).count() == 0
    assert search.ranked(make_docs(docs), asked.limit(0)).count() == 0


def test_equal_bags_are_one_class(spark, make_docs):
    docs = [(i, ("x y", "y  X!", "x x y", "x y other")[i % 4]) for i in range(400)] + [(500, "z")]
    found = search.bags(make_docs(docs), ["x", "y"])
    some = search.classes(found, 401, 1101, top=5).collect()
    # "x y" and "y X" are one class; other terms count in the length only.
    want = {(("x", 1), ("y", 1), 2): [0, 1, 4, 5, 8], (("x", 2), ("y", 1), 3): [2, 6, 10, 14, 18], (("x", 1), ("y", 1), 3): [3, 7, 11, 15, 19]}
    got = {}
    for r in some:
        pairs = np.frombuffer(r["bag"], "<u4").reshape(-1, 2).tolist()
        n = next(n for n in (2, 3) if search.length_number(n, 401, 1101) == r["m"])
        got[(*(("xy"[t], c) for t, c in pairs), n)] = r["members"]
    assert got == want


def test_query_equals_its_sql(spark, sf):
    assert differences(spark, duck(sf), sf, queries.op12_search, queries.ORACLES["op12_search"]) == ""
