"""Encoding texts with a vocabulary file of the tokenizers library, each different piece once.

Pre-tokenizers never join characters across the place where a white-space run
begins, so a text can be cut there and its pieces encoded one by one. Texts repeat
their pieces, so most of them are looked up.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Unicode's White_Space property.
SPACE = "\t-\r \x85\xa0  -     　"
PIECES = {True: re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"), False: re.compile(f"[^{SPACE}]+")}
# White space that the quick ways of splitting do not read as the patterns above do.
PLAIN = re.compile(f"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[\t-\r ][\t-\r ]|[\t-\r ]$")
WHITE = re.compile(f"[{SPACE}]")
CUT = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
# Punctuation that, behind a letter and before white space, is always a piece of its own.
TAIL = ".,;:!?*$#%&|"
# Letters that normalisation maps one to one.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
LONGEST_KEPT = 64
MOST_KEPT = 600_000
JOINED = 2_000
BATCH_BYTES = 4 << 20
FORMATS = [f"<{n}I" for n in range(40)]


class PieceEncoder:
    """Ids of texts as the library gives them, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = self.tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # A vocabulary that drops white space needs only the words between it.
        self.spaced = bool(tokenizer.encode(" ", add_special_tokens=False).ids)
        self.pieces = PIECES[self.spaced]
        self.plain = re.compile(f"{' ?' if self.spaced else ''}[{LETTERS}]+").fullmatch
        self.chars = {ord(c): self._mapped(c) for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c)}
        self.cased = self._mapped("A") == "A"
        self.blank = self.chars[ord(" ")] = self._mapped(" a")[:-1]
        self.sizes: dict[str, int] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _mapped(self, text: str) -> str:
        """A single word in the alphabet of the vocabulary."""
        normal = self.tokenizer.normalizer
        if normal is not None:
            text = normal.normalize_str(text)
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(text)[0][0]

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, from one call on all of them in a row."""
        between = "" if self.spaced else " "
        starts = np.cumsum([0] + [len(p) + len(between) for p in pieces])
        found = self.tokenizer.encode(between.join(pieces), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        at = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
        cuts = np.searchsorted(at, starts)
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _word(self, word: str) -> bytes:
        """Ids of one plain word, with or without a blank before it: the model alone decides."""
        if word.isascii():
            mapped = self.blank + word[1:] if word[0] == " " else word if self.cased else word.lower()
        else:
            mapped = word.translate(self.chars)
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(FORMATS[len(ids)] if len(ids) < len(FORMATS) else f"<{len(ids)}I", *ids)

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are not in ``known``, and of words inside them."""
        known, older, plain, spaced, word = self.known, self.older, self.plain, self.spaced, self._word
        out, odd, parts = {}, [], {}
        for p in pieces:
            core = p.rstrip(TAIL)
            bare = core[1:] if spaced and core[:1] == " " else core
            if bare.isascii() and bare.isalpha() or plain(core):
                if len(core) < len(p):
                    ids = out.get(core) or known.get(core) or older.get(core)
                    if ids is None:
                        ids = known[core] = out[core] = word(core)
                    out[p] = ids + self._tail(p[len(core) :])
                elif p not in out:
                    out[p] = word(p)
            elif p in older:
                out[p] = older[p]
            else:
                odd.append(p)
        runs = []
        for p in odd:
            found = self.pieces.findall(p)
            if found != [p]:
                parts[p] = found
            elif spaced and p[0] == "\n" and p[1:].rstrip(TAIL).isalpha() and plain(p[1:].rstrip(TAIL)):
                parts[p] = ["\n", p[1:]]
            elif spaced and (p.isspace() or not WHITE.match(p)):
                out[p] = self._whole(p)  # would run into the piece before it
            else:
                runs.append(p)
        if parts:
            # The parts of all pieces are looked up, and learnt, together.
            single = list({x for found in parts.values() for x in found})
            ids = dict(zip(single, self._found(single)))
            out.update((p, b"".join(map(ids.__getitem__, found))) for p, found in parts.items())
        for i in range(0, len(runs), JOINED):
            out.update(zip(runs[i : i + JOINED], self._joined(runs[i : i + JOINED])))
        return out

    @functools.cache
    def _tail(self, tail: str) -> bytes:
        return self._whole(tail)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A special token's string inside a text becomes its id, the library's default.
        Such texts go to the library whole.
        """
        if any(s in text for s in self.specials):
            return self._whole(text)
        if len(self.known) > MOST_KEPT:
            self.older, self.known = self.known, {}
        return self._pieces(self._split(text))

    def _split(self, text: str) -> list[str]:
        """Pieces of a text whose ids, in a row, are the text's."""
        if PLAIN.search(text) is not None:
            return self.pieces.findall(text)
        if not self.spaced:
            return text.split()
        first, *rest = text.split(" ")
        return [*self.pieces.findall(first), *[" " + w for w in rest]]

    def _pieces(self, pieces: list[str]) -> bytes:
        return b"".join(self._found(pieces))

    def _found(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece."""
        known, older = self.known, self.older
        ids = list(map(known.get, pieces))
        if None not in ids:
            return ids
        learnt = dict.fromkeys([p for p, x in zip(pieces, ids) if x is None])
        if older:
            learnt = dict(zip(learnt, map(older.get, learnt)))
        if fresh := [p for p, x in learnt.items() if x is None]:
            learnt |= self._learn(fresh)
        if len(max(learnt, key=len)) <= LONGEST_KEPT:
            known.update(learnt)
        else:
            known.update((p, x) for p, x in learnt.items() if len(p) <= LONGEST_KEPT)
        return [learnt[p] if x is None else x for p, x in zip(pieces, ids)]

    def encode_all(self, texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[bytes]:
        """``encode`` of every text of an Arrow array, about ``most`` bytes at a time.

        Arrow splits the texts and numbers their words, so that each different word of a
        batch is looked up once; ids are gathered by those numbers.
        """
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield from self._batch(texts.slice(at, stop - at))
            at = stop

    def _batch(self, texts: pa.Array) -> Iterator[bytes]:
        if len(self.known) > MOST_KEPT:
            self.older, self.known = self.known, {}
        single = np.zeros(len(texts), bool)
        for s in self.specials:
            single |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if self.spaced:
            # A blank behind white space is no place to cut, and one before a new line would look like one put there.
            single |= pc.match_substring_regex(texts, f"[{SPACE}] | \n").to_numpy(zero_copy_only=False)
        shared = texts.filter(pa.array(~single))
        if self.spaced:
            shared = pc.replace_substring_regex(shared, f"([^{SPACE}])\n", "\\1 \n")
        else:
            shared = pc.replace_substring(shared, "\n", " ")
        words = pc.split_pattern(shared, " ")
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        numbered = words.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = numbered.indices.to_numpy()
        last = np.cumsum(counts, dtype=np.int64)
        if self.spaced:
            # Words take the blank before them along; the first of a text and those behind a new line have none.
            first = last - counts
            leading, number = np.unique(numbers[first], return_inverse=True)
            numbers = numbers.copy()
            numbers[first] = len(pieces) + number
            pieces = [w if w[:1] == "\n" else " " + w for w in pieces] + [pieces[k] for k in leading.tolist()]
        found = self._found(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        n = sizes[numbers]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(sizes) - sizes)[numbers] - ends + n, n)
        place += np.arange(len(place))
        ids = memoryview(ids[place]).cast("B")
        cuts = iter((4 * ends[last - 1]).tolist())
        begin = 0
        for k, alone in enumerate(single.tolist()):
            if alone:
                yield self.encode(texts[k].as_py())
            else:
                end = next(cuts)
                yield bytes(ids[begin:end])
                begin = end

    def lengths(self, texts: list[str]) -> list[int]:
        """How many ids each text of a batch has; pieces new to the worker are encoded once for all texts."""
        if len(self.sizes) > MOST_KEPT:
            self.sizes = {}
        if len(self.known) > MOST_KEPT:
            self.older, self.known = self.known, {}
        whole = [any(s in t for s in self.specials) for t in texts]
        pieces = [[] if w else self._split(t) for t, w in zip(texts, whole)]
        sizes = self.sizes
        fresh = set().union(*pieces).difference(sizes)
        learnt = {p: len(ids) // 4 for p, ids in self._learn(list(fresh)).items()}
        sizes.update((p, n) for p, n in learnt.items() if len(p) <= LONGEST_KEPT)
        # Long pieces are known for this batch only.
        known = sizes if len(learnt) == sum(len(p) <= LONGEST_KEPT for p in learnt) else {**learnt, **sizes}
        return [len(self._whole(t)) // 4 if w else sum(map(known.__getitem__, p)) for t, w, p in zip(texts, whole, pieces)]

    def slices(self, text: str, most: int) -> Iterator[str]:
        """Parts of about ``most`` characters, cut only where white space begins after other text."""
        if len(text) <= most or any(s in text for s in self.specials):
            yield text
            return
        at = 0
        while len(text) - at > most:
            cut = CUT.search(text, at + most)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder per vocabulary and worker process."""
    return PieceEncoder(path)
