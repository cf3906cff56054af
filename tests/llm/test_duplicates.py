import hashlib
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import components, exact, simhash
from ledgerloom.llm.store import fresh_folder


def low(text):
    return (text or "").encode().lower()


def brute_fingerprint(text):
    import xxhash

    words = low(text).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of (id, fingerprint); smallest non-null id reachable, per fingerprint."""
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[find(f)].append(i)
    return {f: min(least[find(f)], default=None) for f in distinct}


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_near_duplicates_against_brute_force(make_docs, odd_rows, monkeypatch, hot):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n)) for n in (3, 40, 200, 400)]
    rows = list(odd_rows)
    for k in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "new" + str(rng.randrange(30))
        rows.append((100 + k, " ".join(words)))
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.DISTANCE, hot))
    found = simhash.near_duplicates(make_docs(rows)).withColumn("f", simhash.fingerprint_text())
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    least = brute_components(prints)
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    want = [(i, int(f) if f < 1 << 63 else f - (1 << 64), least[f], f"{f:016x}") for i, f in prints]
    assert sorted(map(tuple, found.collect()), key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))


def test_near_duplicates_of_nothing(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert [tuple(r) for r in simhash.near_duplicates(make_docs([(None, None)])).collect()] == [(None, 0, None)]


def test_keys_meet_for_every_pair_within_four_bits():
    rng = random.Random(5)
    for _ in range(1500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        row, key = simhash.keys(np.array([x, y], np.uint64).view(np.int64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_codewords_are_within_three_bits():
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    byte, error = simhash._golay()
    rest = byte[0][words & 255] ^ byte[1][words >> 8 & 255] ^ byte[2][words >> 16]
    assert np.bitwise_count(error).max() == 3 and len(set(error.tolist())) == 2048
    code = words ^ error[rest]
    again = byte[0][code & 255] ^ byte[1][code >> 8 & 255] ^ byte[2][code >> 16]
    assert (again == 0).all() and (code >> 11 == simhash.codeword_index(words)).all()


def test_components_of_paths_and_hubs(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5001), (5001, 5000)]
    names = list(range(6000))
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    groups = [[names[k] for k in range(301)], [names[1000 + k] for k in range(200)], [names[5000], names[5001]]]
    assert found == {v: min(g) for g in groups for v in g}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"window_bytes": 2000, "bucket_bytes": 1500}])
def test_exact_duplicates_against_brute_force(spark, make_docs, odd_rows, documents, sizes):
    rows = odd_rows + [(r.doc_id + 1000, r.text) for r in documents.limit(100).collect()] * 2
    found = exact.exact_duplicates(make_docs(rows), **sizes).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    want = []
    for i, t in rows:
        group = groups[low(t)]
        keep = max((x for x in group if x is not None), default=None)
        want.append((i, keep, len(group), i == keep, hashlib.sha256(low(t)).hexdigest()))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert exact.exact_duplicates(make_docs([])).count() == 0


def test_grace_hashing_recurses_and_clears_its_files(spark):
    folder = fresh_folder(spark, "spill-test")
    rng = random.Random(7)
    texts = [bytes([rng.randrange(256)]) * 50 for _ in range(2000)]
    # Few different hashes, so that buckets stay full through several levels.
    rows = [(hash(t) % 5, t, k) for k, t in enumerate(texts)]
    names = defaultdict(set)
    for name, k in exact.resolve(rows, 2000, folder):
        names[texts[k]].add(name)
    assert len(names) == len(set(texts)) and all(len(v) == 1 for v in names.values())
    assert len({n for v in names.values() for n in v}) == len(names)
    assert not os.path.exists(folder) or not os.listdir(folder)


def test_open_table_compares_complete_texts():
    table = exact.OpenTable(2)
    numbers = [table.place(7, t) for t in (b"a", b"b", b"a", b"c", b"b")]
    assert numbers == [0, 1, 0, 2, 1]
    assert [table.place(7, t) for t in (b"c", b"d")] == [2, 3]


def test_rows_of_one_text_do_not_wait_for_the_end(tmp_path):
    read = 0

    def rows():
        nonlocal read
        for k in range(20_000):
            read += 1
            yield 7, b"the same text", [k]

    found = exact.resolve(rows(), 10_000, str(tmp_path))
    name, ids = next(found)
    assert ids == [0] and read < 200
    rest = list(found)
    assert {n for n, _ in rest} == {name} and [i for _, some in rest for i in some] == list(range(1, 20_000))


def test_ids_fill_a_window_too(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")).coalesce(1)
    seen = exact.windows(docs, "doc_id", "text", window_bytes=64_000).collect()
    assert len(seen) >= 5 and sum(len(r["ids"]) for r in seen) == 5000


def test_links_are_worked_out_once(spark):
    given = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            given.add(batch.num_rows)
            yield batch

    rows = spark.range(1, 50).selectExpr("id AS a", "id - 1 AS b").unionAll(spark.sql("SELECT 70L, 70L"))
    found = components.components(rows.mapInArrow(counted, "a long, b long")).collect()
    assert given.value == 50
    assert sorted(map(tuple, found)) == [(k, 0) for k in range(50)]


def test_fingerprints_of_a_batch_of_many_texts(spark):
    texts = [None if k % 97 == 0 else f"one {k} two {k % 7} three" for k in range(2 * simhash.TEXTS + 3)]
    found = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    want = [simhash.fingerprint(t or "") for t in texts]
    assert [r["fingerprint"] % 2**64 for r in found.sort("doc_id").collect()] == want
