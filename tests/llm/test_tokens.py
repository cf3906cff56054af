import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing, range_coder, token_counts, token_files
from ledgerloom.llm.tokens import PieceEncoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
BYTE, WORD = (public_tokenizers.path(n) for n in NAMES)


def plain_ids(path, text):
    return np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_librarys_ids(path):
    enc = PieceEncoder(path)
    whole = Tokenizer.from_file(path)
    rng = random.Random(1)
    signs = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0    　﻿​" + "   abAB'sdét12.,;-!?é́İΣςß漢🙂"
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 16)))
        expected = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc.encode(text) == expected
        assert b"".join(map(enc.encode, enc.slices(text, 3))) == expected


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("most", [1, 200, 1 << 20])
def test_batches_give_the_librarys_ids(path, most):
    whole = Tokenizer.from_file(path)
    rng = random.Random(2)
    signs = "\t\n\n\x0b\r\x1c\x85\xa0\u2003\u3000 " + "      abAB'sdét12.,;-!?é\u0301İΣß漢🙂"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 16))) for _ in range(2000)]
    texts += ["", " ", "  ", "a <|endoftext|> b", "\n\nfoo. Bar\nBaz, x", " \nfoo bar\n bar ", "x" * 300 + " y\n", "\x1cab foo\x1c ab"]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    enc = PieceEncoder(path)
    assert list(enc.encode_all(pa.array(texts), most)) == want
    assert list(enc.encode_all(pa.array(texts).slice(7, 900), most)) == want[7:907]
    assert list(enc.encode_all(pa.array([], pa.string()), most)) == []


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_a_batch_encodes_each_word_once(path, monkeypatch):
    enc = PieceEncoder(path)
    asked, word = [], enc._word
    monkeypatch.setattr(enc, "_word", lambda w: asked.append(w) or word(w))
    texts = [f"x plain words, words. plain; {w} {w}! words" for w in ("more", "even", "plain")] * 5
    assert list(enc.encode_all(pa.array(texts))) == [plain_ids(path, t).tobytes() for t in texts]
    assert len(asked) == len(set(asked))


def test_counts_of_odd_rows(make_docs, odd_rows):
    found = token_counts.token_counts(make_docs(odd_rows), WORD, batch_bytes=4096).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    want = [(i, len((t or "").encode()), len(plain_ids(WORD, t or ""))) for i, t in odd_rows]
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(make_docs([]), WORD).count() == 0


def test_batches_are_balanced_and_whole():
    enc = PieceEncoder(WORD)
    texts = ["a b c " * 50, "", "d " * 2000, "e"]
    sizes = [len(t) for t in texts]
    batches = list(token_counts.batches_of(texts, sizes, enc.slices, 500))
    assert all(sum(len(p) for _, p in b) <= 510 or len(b) == 1 for b in batches)
    parts = defaultdict(str)
    for b in batches:
        for row, part in b:
            parts[row] += part
    assert [parts[k] for k in range(4)] == texts


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 9000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, range_coder.MOST_ID, n), rng.zipf(1.3, n) % 50_000, np.zeros(n)):
        ids = ids.astype("<u4")
        blocks = range_coder.encode(ids)
        assert (range_coder.decode(blocks) == ids).all()
        # Blocks stand alone.
        for k in range(0, len(blocks), 2):
            size = range_coder.BLOCK
            assert (range_coder.decode(blocks[k : k + 1]) == ids[k * size : (k + 1) * size]).all()


def test_range_coder_uses_contexts_and_checksums():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 50_000, 100)
    ids = np.tile(phrase, 40).astype("<u4")
    blocks = range_coder.encode(ids)
    assert sum(len(p) for _, _, p in blocks) < len(ids)
    n, crc, payload = blocks[0]
    with pytest.raises(ValueError):
        range_coder.decode([(n, crc ^ 1, payload)])
    with pytest.raises(ValueError):
        range_coder.encode(np.array([range_coder.MOST_ID], "<u4"))


def test_range_coder_holds_little_beside_the_ids():
    ids = np.random.default_rng(3).zipf(1.3, 512 * range_coder.BLOCK).astype(np.int64) % 50_000
    ids = ids.astype("<u4")
    tracemalloc.start()
    try:
        blocks = range_coder.encode(ids)
        assert tracemalloc.get_traced_memory()[1] < 24 * len(ids)
    finally:
        tracemalloc.stop()
    assert (range_coder.decode(blocks) == ids).all()


def test_carries_run_through_full_words():
    words = np.array([5, 0xFFFFFFFF, 0xFFFFFFFF, 7, 8, 9], np.uint32)
    range_coder._carry(words, np.array([2, 5]))
    assert words.tolist() == [6, 0, 0, 7, 8, 10]


def test_token_files_of_odd_rows(make_docs, odd_rows):
    found = sorted(map(tuple, token_files.token_file_rows(make_docs(odd_rows), WORD, 1).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((i for i, _ in odd_rows), key=lambda i: (i is not None, i))
    start, texts = 0, defaultdict(list)
    for i, t in odd_rows:
        ids = np.append(plain_ids(WORD, t or ""), 1).astype("<u4").tobytes()
        texts[i].append((len(ids) // 4, zlib.crc32(ids)))
    for i, at, n, crc in found:
        assert at == start and (n, crc) in texts[i]
        texts[i].remove((n, crc))
        start += n
    assert token_files.token_file_rows(make_docs([]), WORD, 1).count() == 0


def test_token_files_in_small_chunks(documents, monkeypatch, tmp_path):
    class Keep(bytearray):
        write = bytearray.extend

    import io

    import pyarrow as pa

    buffer = io.BytesIO()
    monkeypatch.setattr(token_files, "CHUNK", 2 * range_coder.BLOCK)
    writer = token_files.Writer(buffer)
    rng = np.random.default_rng(2)
    docs = [(k, rng.integers(0, 999, int(n)).astype("<u4").tobytes()) for k, n in enumerate(rng.integers(0, 3000, 30))]
    for k, ids in docs:
        writer.add(k, ids)
    writer.close()
    assert list(token_files.read_file(pa.BufferReader(buffer.getvalue()))) == docs


def check_packing(rows, capacity):
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packing_of_odd_rows(make_docs, odd_rows):
    rows = packing.packed_documents(make_docs(odd_rows), BYTE, 2).collect()
    used = check_packing(rows, 1024)
    total = sum(r["length"] for r in rows)
    assert used <= -(-total // 1024) + 2
    want = []
    for i, t in odd_rows:
        ids = np.append(plain_ids(BYTE, t or ""), 2).astype("<u4")
        first = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    assert packing.packed_documents(make_docs([]), BYTE, 2).count() == 0


def test_packing_is_near_the_least_number_of_sequences(documents):
    rows = packing.packed_documents(documents, BYTE, 2).collect()
    used = check_packing(rows, 1024)
    total = sum(r["length"] for r in rows)
    assert used <= 1.03 * total / 1024 + 2


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 3000) if seed else np.full(3000, 40)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    runs = packing.plan(histogram, 64)
    ranks = defaultdict(list)
    rows = []
    for length, a, b, sequence, offset in runs.tolist():
        ranks[length] += range(a, b)
        rows += [{"sequence_id": sequence + k, "offset": offset, "length": length} for k in range(b - a)]
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    used = check_packing(rows, 64)
    if seed:
        # No two lengths above one half share a sequence.
        least = max(lengths.sum() / 64, (lengths > 32).sum())
        assert used <= 1.01 * least + 1
    assert len(packing.plan({}, 64)) == 0


def test_patterns_fill_a_sequence():
    found = packing.patterns(np.arange(1, 13), 12)
    assert set(map(tuple, found.tolist())) == {
        (a, b, 12 - a - b) for a in range(13) for b in range(a, 13) if b <= 12 - a - b and (a == 0 or b > 0) and 12 - a - b > 0
    }


def test_batch_lengths_are_those_of_single_texts(documents):
    texts = [r["text"] or "" for r in documents.limit(80).collect()] + ["", " ", "a <|endoftext|> b", "x" * 300, "Ünïcödé  straße", "\n\n"]
    for path in (WORD, BYTE):
        enc = PieceEncoder(path)
        want = [len(enc.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
        assert enc.lengths(texts) == want and enc.lengths(texts[::-1]) == want[::-1]
