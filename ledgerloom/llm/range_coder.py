"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that start from nothing, so each can be read alone. Every id is
predicted by the id that last followed the same two ids (order 2), by the one that last
followed the same id (order 1), and by the size class ids tend to have (order 0). The
three share one distribution: its weights are learnt per block, given which predictions
exist and whether the last id was foreseen, and the mixture narrows the range. Blocks
are independent, so many are coded side by side, one id of each per step.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
LANES = 4096
MOST_ID = 1 << 20
TABLE_BITS = 9
SYMBOLS = 7  # order 2, order 1, then size classes
TOTAL_BITS = 12
FULL = ((1 << TOTAL_BITS) - SYMBOLS) << 3
# Weights move at every step of a young block, later at every second one.
YOUNG = 64
# Classes of ids: first id and number of bits of the place inside.
FIRST = np.array([0, 0, 0, 1024, 5120, 21504, 54272], np.int64)
BITS = np.array([0, 0, 10, 12, 14, 15, 20], np.uint64)
CLASSES = np.repeat(np.arange(2, 7), np.diff(np.r_[FIRST[2:], MOST_ID])).astype(np.int8)
# Steps that change places with lanes at once, so that the copies stay in the cache.
TURNED = 64
COLUMNS = np.arange(SYMBOLS + 1, dtype=np.int16)
TARGETS = np.where(COLUMNS[None, :] > np.arange(SYMBOLS)[:, None], FULL, 0).astype(np.int16)
U32, LOW32 = np.uint64(32), np.uint64(0xFFFFFFFF)
TOTAL = np.uint64(TOTAL_BITS)
ONES, TOP = np.uint64(0x0101010101010101), np.uint64(56)


class _Model:
    """Predictions and weights of blocks coded side by side."""

    def __init__(self, lanes: int):
        size = 1 << TABLE_BITS
        self.lane = np.arange(lanes)
        self.base = self.lane * size
        self.cell = self.lane * (SYMBOLS + 1)
        self.after1 = np.zeros(lanes * size, np.int32)
        self.after2 = np.zeros(lanes * size, np.int32)
        start = np.linspace(0, FULL, SYMBOLS + 1).astype(np.int16)
        self.weights = np.tile(start, (8 * lanes, 1))
        # The same memory with one element per row, which is quicker to write.
        self.rows = self.weights.view(f"V{self.weights.itemsize * (SYMBOLS + 1)}").ravel()
        self.last1 = np.zeros(lanes, np.int64)
        self.last2 = np.zeros(lanes, np.int64)
        self.foreseen = np.zeros(lanes, np.int8)
        self.starts = np.arange(8) * lanes
        self.columns = np.tile(COLUMNS, (lanes, 1))

    def predict(self):
        """Ids plus one that orders 2 and 1 expect (0: none), and the summed distribution."""
        mask = (1 << TABLE_BITS) - 1
        one = self.last1 * 40503
        self.at1 = self.base + ((one >> 4) & mask)
        self.at2 = self.base + ((one + self.last2 * 30011 >> 5) & mask)
        p1 = self.after1[self.at1]
        p2 = self.after2[self.at2]
        # Which predictions exist, and whether the last id was foreseen.
        state = (p2 > 0).view(np.int8)
        state += state
        state += (p1 > 0).view(np.int8)
        state += state
        state += self.foreseen
        self.row = self.starts.take(state, mode="clip")
        self.row += self.lane
        self.seen = self.weights.take(self.row, axis=0, mode="clip")
        cum = self.seen >> 3
        cum += self.columns
        return p2, p1, cum

    def learn(self, next_id: np.ndarray, symbol: np.ndarray, step: int) -> None:
        """next_id: ids plus one, as 32-bit integers."""
        if step < YOUNG or step & 1:
            seen = self.seen
            change = TARGETS.take(symbol, axis=0, mode="clip")
            change -= seen
            change >>= 4
            seen += change
            self.rows[self.row] = seen.view(self.rows.dtype).ravel()
        self.after1[self.at1] = next_id
        self.after2[self.at2] = next_id
        self.last2, self.last1 = self.last1, next_id.astype(np.int64)
        self.foreseen = (symbol < 2).view(np.int8)


def _encode_lanes(ids: np.ndarray) -> list[bytes]:
    """ids: (lanes, steps). One payload per lane."""
    lanes, steps = ids.shape
    model = _Model(lanes)
    # Only what is written is ever touched.
    words = np.empty(lanes * (steps + 4), np.uint32)
    first = model.lane * (steps + 4)
    pos = first.copy()
    low = np.zeros(lanes, np.uint64)
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for step in range(steps):
        if not step % TURNED:
            turned = np.ascontiguousarray(ids[:, step : step + TURNED].T, np.int32)
        x = turned[step % TURNED]
        symbol = CLASSES.take(x).astype(np.int64)
        offset = x - FIRST.take(symbol, mode="clip")
        x += 1
        p2, p1, cum = model.predict()
        hit = p1 == x
        np.putmask(symbol, hit, 1)
        np.putmask(offset, hit, 0)
        hit = p2 == x
        np.putmask(symbol, hit, 0)
        np.putmask(offset, hit, 0)
        offset = offset.view(np.uint64)
        flat = cum.ravel()
        cell = model.cell + symbol
        lo = flat.take(cell, mode="clip").astype(np.uint64)
        cell += 1
        width = flat.take(cell, mode="clip").astype(np.uint64)
        width -= lo
        span >>= TOTAL
        lo *= span
        span *= width
        span >>= BITS.take(symbol, mode="clip")
        offset *= span
        lo += offset
        low += lo
        carried = np.flatnonzero(low < lo)
        if carried.size:
            _carry(words, pos[carried] - 1)
        short = np.flatnonzero(span <= LOW32)
        if short.size:
            at, part = pos.take(short), low.take(short)
            words[at] = part >> U32
            pos[short] = at + 1
            low[short] = part << U32
            span[short] = span.take(short) << U32
        model.learn(x, symbol, step)
    for _ in range(2):
        words[pos] = low >> U32
        low <<= U32
        pos += 1
    words = words.reshape(lanes, steps + 4)
    return [words[k, :n].astype("<u4", copy=False).tobytes() for k, n in enumerate((pos - first).tolist())]


def _carry(words: np.ndarray, at: np.ndarray) -> None:
    """Adds one to the words at different places, and to those before them that overflow."""
    while at.size:
        sums = words[at] + np.uint32(1)
        words[at] = sums
        at = at[sums == 0] - 1


def _decode_lanes(payloads: list[bytes], steps: int) -> np.ndarray:
    lanes = len(payloads)
    model = _Model(lanes)
    sizes = np.array([len(p) // 4 for p in payloads])
    begin = np.r_[0, np.cumsum(sizes + 2)[:-1]]
    words = np.frombuffer(b"".join([x for p in payloads for x in (p, bytes(8))]), "<u4")
    value = (words[begin].astype(np.uint64) << U32) | words[begin + 1]
    pos = begin + 2
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    most = np.uint64((1 << TOTAL_BITS) - 1)
    limits = (np.uint64(1) << BITS) - np.uint64(1)
    following = (FIRST + 1).astype(np.int32)
    out = np.empty((lanes, steps), "<u4")
    turned = np.empty((TURNED, lanes), np.int32)
    for step in range(steps):
        p2, p1, cum = model.predict()
        span >>= TOTAL
        point = np.minimum(value // span, most).astype(np.int16)
        # Eight truth values of a row as one number; their sum ends up in its top byte.
        count = (cum <= point[:, None]).view(np.uint64).ravel()
        count *= ONES
        count >>= TOP
        symbol = count.view(np.int64)
        symbol -= 1
        flat = cum.ravel()
        cell = model.cell + symbol
        lo = flat.take(cell, mode="clip").astype(np.uint64)
        cell += 1
        width = flat.take(cell, mode="clip").astype(np.uint64)
        width -= lo
        lo *= span
        value -= lo
        span *= width
        span >>= BITS.take(symbol, mode="clip")
        offset = np.minimum(value // span, limits.take(symbol, mode="clip"))
        value -= span * offset
        x = following.take(symbol, mode="clip")
        x += offset.astype(np.int32)
        np.copyto(x, p1, where=symbol == 1)
        np.copyto(x, p2, where=symbol == 0)
        short = np.flatnonzero(span <= LOW32)
        if short.size:
            at = pos.take(short)
            value[short] = (value.take(short) << U32) | words.take(at, mode="clip")
            span[short] = span.take(short) << U32
            pos[short] = at + 1
        model.learn(x, symbol, step)
        np.subtract(x, 1, out=turned[step % TURNED])
        if step % TURNED == TURNED - 1 or step == steps - 1:
            begun = step // TURNED * TURNED
            out[:, begun : step + 1] = turned[: step + 1 - begun].T
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> list[tuple[int, int, bytes]]:
    """(number of ids, crc32 of the ids as little-endian 32-bit integers, payload) per block."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >= MOST_ID:
        raise ValueError(f"ids must be below {MOST_ID}")
    count = -(-len(ids) // block)
    parts = [ids[k * block : (k + 1) * block] for k in range(count)]
    out = []
    for first in range(0, count, LANES):
        lanes = ids[first * block : (first + LANES) * block]
        if len(lanes) % block:
            lanes = np.append(lanes, np.zeros(-len(lanes) % block, ids.dtype))
        out += _encode_lanes(lanes.reshape(-1, block))
    return [(len(p), zlib.crc32(p.tobytes()), payload) for p, payload in zip(parts, out)]


def decode(blocks: list[tuple[int, int, bytes]], block: int = BLOCK) -> np.ndarray:
    """Ids of blocks; a block that does not match its checksum raises."""
    out = []
    for first in range(0, len(blocks), LANES):
        some = blocks[first : first + LANES]
        lanes = _decode_lanes([p for _, _, p in some], block)
        for (n, crc, _), row in zip(some, lanes):
            ids = row[:n]
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError("a block does not match its checksum")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, "<u4")
