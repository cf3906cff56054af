"""Periodic runs of words, found in overlapping tiles per octave of periods.

A run is a maximal stretch with smallest period q and at least ``max(LEAST, 2 * q)`` words.
``tiles`` explodes a document: periods up to an octave share tiles that overlap by more than
the shortest run of that octave, so every such stretch lies whole in some tile; octaves whose tile
would hold the whole document share one. Tiles of a document that may have several are dealt to
tasks by document, octave and place, so a long document is solved in many.

``solve`` looks at boundaries in a tile, as far apart as the octave's smallest period. A run
holds some boundary c with its period c..c+p, so the lengths to which the text goes on alike
after c and c+p, and before them, add up to its length. One of the two is at least half a period:
boundaries without equal hashed blocks there are left out (equal blocks have equal hashes, so none
is lost). For the others the Z-functions of the text behind and before the boundary give exact
lengths for all periods of the octave at once. ``stitch`` shuffles the intervals by document
and period and joins those that overlap by a period.

Defined results: a null or empty text has no words and no run; rows with the same id and text give the
same result each; a null id is an id like any other; an empty table gives an empty table.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 12
# Words in the smallest tile, and how many of the octave's smallest periods a larger one has.
TILE = 8192
PERIODS = 32
# Z-functions look this many of the octave's smallest periods either way.
REACH = 8
Rewrite = Callable[[object, list[bytes]], list[bytes]]


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def z_function(x: list[int], most: int) -> list[int]:
    """How far ``x`` goes on like its own beginning from each of its first ``most`` places on."""
    n = len(x)
    most = min(most, n)
    z = [0] * most
    left = right = 0
    for i in range(1, most):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    h = x * np.uint64(0x9E3779B97F4A7C15) + y * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def _equal_blocks(names: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(j, r) where the block at ``j * step`` equals the one ``step + r`` later, 0 <= r < step."""
    rows = -(-(len(names) - step) // step)
    if rows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    later = np.zeros(rows * step, np.uint64)
    later[: len(names) - step] = names[step:]
    return np.nonzero(later.reshape(rows, step) == names[: rows * step : step][:rows, None])


def _survivors(names: np.ndarray, size: int, octave: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, period) with equal blocks of ``size`` words behind or before boundary and period."""
    if octave == 0:
        found = []
        for p in range(1, 8):
            c = np.arange(0, max(0, n - p), 4)
            ahead = c[c + p + size <= n]
            found.append((ahead[names[ahead] == names[ahead + p]], p))
            back = c[(c >= size) & (c + p <= n)]
            found.append((back[names[back - size] == names[back + p - size]], p))
        c = np.concatenate([f for f, _ in found])
        p = np.concatenate([np.full(len(f), p) for f, p in found])
    else:
        step = 1 << octave
        j, r = _equal_blocks(names, step)
        i, s = _equal_blocks(names[step - size :], step)
        c, p = np.concatenate([j, i + 1]) * step, np.concatenate([r, s]) + step
        inside = c + p <= n
        c, p = c[inside], p[inside]
    if not len(c):
        return c, p
    both = np.unique(c * (n + 1) + p)
    return both // (n + 1), both % (n + 1)


def _at_boundary(words: np.ndarray, c: int, low: int, high: int, reach: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the stretches around boundary ``c`` with periods from ``low`` to ``high``."""
    n = len(words)
    ahead = z_function(words[c : c + reach].tolist(), high + 1)
    before = words[max(0, c - reach) : c][::-1].tolist()
    upto = min(n, c + high)
    around = words[max(0, c - reach) : upto][::-1].tolist()
    # The reversed text up to c + p starts at place upto - (c + p) of ``around``.
    back = z_function([*before, -1, *around], len(before) + 1 + upto - c - low + 1)
    for p in range(low, min(high, n - c) + 1):
        s, e = c - back[len(before) + 1 + upto - c - p], c + p + (ahead[p] if p < len(ahead) else 0)
        if e == c + reach:
            e = _end(words, e, p, reach)
        if e - s >= max(LEAST, 2 * p):
            yield s, e, p


def _end(words: np.ndarray, e: int, p: int, step: int) -> int:
    """Where a stretch with period ``p`` that reaches ``e`` ends."""
    while e < len(words):
        differ = np.flatnonzero(words[e : e + step] != words[e - p : e - p + len(words[e : e + step])])
        if len(differ):
            return e + int(differ[0])
        e, step = min(len(words), e + step), 2 * step
    return e


def solve(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, period), all runs of an array of numbers of zero or more.

    Numbers below minus one that occur once may stand between texts of at most ``longest``
    words; no run reaches across them.
    """
    n = len(words)
    longest = n if longest is None else longest
    names = words.astype(np.int64).view(np.uint64) * np.uint64(0x165667B19E3779F9)
    names ^= names >> np.uint64(31)
    size, octave = 1, 0
    runs: list[tuple[int, int, int]] = []
    while (2 << octave) <= longest:
        want = 2 if octave == 0 else 1 << (octave - 1)
        while size < want and len(names) > size:
            names = _mixed(names[:-size], names[size:])
            size *= 2
        if size < want:
            break
        c, p = _survivors(names, size, octave, n)
        low, high, reach = (1, 7, 64) if octave == 0 else (1 << octave, (2 << octave) - 1, REACH << octave)
        # Inside a run of a period that divides this one nothing new begins.
        free = np.ones(len(c), bool)
        for s, e, d in runs:
            if e - s >= low:
                a, b = np.searchsorted(c, [s, e])
                free[a:b] &= (p[a:b] % d != 0) | (c[a:b] + p[a:b] > e)
        found: dict[int, list[list[int]]] = {}
        seen = -1
        for at, q in zip(c[free].tolist(), p[free].tolist()):
            last = found.get(q)
            if at == seen or (last and at + q <= last[-1][1]):
                continue
            seen = at
            for s, e, d in _at_boundary(words, at, low, high, reach):
                parts = found.setdefault(d, [])
                if parts and parts[-1][1] - s >= d:
                    parts[-1][0], parts[-1][1] = min(s, parts[-1][0]), max(e, parts[-1][1])
                else:
                    parts.append([s, e])
        for d, parts in found.items():
            runs += [(s, e, d) for s, e in parts if _primitive(words[s : s + d])]
        octave = 3 if octave == 0 else octave + 1
    return runs


def _primitive(root: np.ndarray) -> bool:
    """Whether no shorter stretch repeated makes up ``root``."""
    n = rest = len(root)
    prime = 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime:
            prime += 1
            continue
        while rest % prime == 0:
            rest //= prime
        d = n // prime
        if np.array_equal(root[d:], root[:-d]):
            return False
    return True


def cover(n: int, tile: int = TILE, periods: int = PERIODS) -> list[tuple[int, int, int, int]]:
    """(least period, largest period, start, end) of the tiles of a text of ``n`` words."""
    out = []
    low, high = 1, max(7, tile // periods * 2 - 1)
    while low * 2 <= n:
        size = max(tile, (high + 1) // 2 * periods)
        if size >= n:
            out.append((low, n, 0, n))
            break
        # Twice the largest period, and no less than the shortest run.
        shared = max(LEAST, 2 * high)
        for start in range(0, n - shared, size - shared):
            out.append((low, high, start, min(n, start + size)))
        low, high = high + 1, 2 * high + 1
    return out


def _numbered(words: list[bytes]) -> np.ndarray:
    """Every word as the number of its first kind in the text."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, text): rows with equal id and digest are alike."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.md5(text).alias("_digest"), text.alias("_text"))


def tiles(keyed: DataFrame, rewrite: Rewrite | None = None, tile: int = TILE, periods: int = PERIODS) -> DataFrame:
    """(_id, _digest, low, high, at, words): the tiles of every document, words as 32-bit numbers."""
    id_type = keyed.schema["_id"].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for k, (i, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                words = split_words(text)
                if len(words) < LEAST:
                    continue
                numbers = _numbered(rewrite(i, words) if rewrite else words)
                for low, high, a, b in cover(len(words), tile, periods):
                    rows.append((low, high, a, numbers[a:b].tobytes()))
                    owner.append(k)
            if rows:
                low, high, at, words = zip(*rows)
                some = pa.array(owner, pa.int64())
                columns = [batch.column(0).take(some), batch.column(1).take(some)]
                columns += [pa.array(x, pa.int64()) for x in (low, high, at)] + [pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_digest", "low", "high", "at", "words"])

    return keyed.mapInArrow(explode, f"_id {id_type}, _digest string, low long, high long, at long, words binary")


def fragments(dealt: DataFrame) -> DataFrame:
    """(_id, _digest, period, start, end): the runs inside each tile, places counted in the document."""
    id_type = dealt.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(b, np.int32).astype(np.int64) for b in batch.column(5).to_pylist()]
            low, high, at = (batch.column(k).to_pylist() for k in (2, 3, 4))
            # Tiles of like size are solved side by side, a number of their own between them.
            sizes: dict[int, list[int]] = {}
            for k, words in enumerate(held):
                sizes.setdefault(len(words).bit_length(), []).append(k)
            owner, out = [], []
            for some in sizes.values():
                starts = np.cumsum([0] + [len(held[k]) + 1 for k in some])
                line = np.full(starts[-1], -2, np.int64)
                for a, k in zip(starts.tolist(), some):
                    line[a : a + len(held[k])] = held[k]
                line[starts[1:] - 1] = -2 - np.arange(len(some))
                longest = max(len(held[k]) for k in some)
                for s, e, p in solve(line, longest):
                    n = int(np.searchsorted(starts, s, "right")) - 1
                    k = some[n]
                    if low[k] <= p <= high[k]:
                        shift = at[k] - int(starts[n])
                        owner.append(k)
                        out.append((p, s + shift, e + shift))
            if out:
                row = pa.array(owner, pa.int64())
                columns = [batch.column(0).take(row), batch.column(1).take(row), *(pa.array(x, pa.int64()) for x in zip(*out))]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_digest", "period", "start", "end"])

    return dealt.mapInArrow(run, f"_id {id_type}, _digest string, period long, start long, end long")


def stitch(found: DataFrame) -> DataFrame:
    """Runs from fragments: of one document and period, those that share a period's words are one."""
    key = ["_id", "_digest", "period"]
    order = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(before - F.col("start") < F.col("period"), F.lit(True)).cast("int")
    numbered = found.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order))
    joined = numbered.groupBy(*key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.select(*key, "start", (F.col("end") - F.col("start")).alias("length"))


def word_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None, tile: int = TILE, periods: int = PERIODS
) -> DataFrame:
    """(_id, _digest, period, start, length): all runs of every document.

    ``_digest`` is the MD5 of the text. ``rewrite`` may change a document's words first, not their number.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs, id_col, text_col)
    # A text of fewer characters has no second tile, so it stays where it is read.
    far = F.length("_text") >= 2 * tile
    dealt = tiles(keyed.filter(far), rewrite, tile, periods).repartition(parts, "_id", "_digest", "low", "at")
    return stitch(fragments(tiles(keyed.filter(~far), rewrite, tile, periods).unionByName(dealt)))


def run_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None, tile: int = TILE, periods: int = PERIODS
) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed).

    start to exponent_milli are those of the longest run (then the first, then the shortest period);
    ``collapsed`` is the text without what runs repeat, its words joined by one space.
    """
    keyed = _keyed(docs, id_col, text_col)
    found = word_runs(docs, id_col, text_col, rewrite, tile, periods)
    # A document has fewer runs than words.
    runs = found.groupBy("_id", "_digest").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("_runs"))
    runs = runs.withColumnsRenamed({"_id": "_run_id", "_digest": "_run_digest"}).hint("shuffle_hash")
    same = F.col("_id").eqNullSafe(F.col("_run_id")) & (F.col("_digest") == F.col("_run_digest"))
    rows = keyed.join(runs, same, "left").select("_id", "_text", "_runs")
    id_type = rows.schema["_id"].dataType.simpleString()
    numbers = ("n_runs", "start", "length", "period", "exponent_milli")
    names = ["_id", *numbers, "runs_sha256", "collapsed_sha256", "collapsed"]
    schema = f"_id {id_type}, {', '.join(f'`{n}` long' for n in numbers)}, runs_sha256 string, collapsed_sha256 string, collapsed string"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, some in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = split_words(text)
                out.append(_described(rewrite(i, words) if rewrite else words, some or []))
            columns = list(zip(*out)) or [()] * 8
            arrays = [pa.array(x, pa.int64()) for x in columns[:5]] + [pa.array(x, pa.string()) for x in columns[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return rows.mapInArrow(describe, schema).withColumnRenamed("_id", id_col)


def _described(words: list[bytes], runs: list[dict]) -> tuple:
    """Numbers, digests and collapsed text of a document, its runs by start and period."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for r in runs:
            edge[r["start"] + r["period"]] += 1
            edge[r["start"] + r["length"]] -= 1
        words = [w for w, k in zip(words, np.cumsum(edge).tolist()) if not k]
    kept = b" ".join(words)
    listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
    best = max(runs, key=lambda r: (r["length"], -r["start"], -r["period"]), default=None)
    longest = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
    return (len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass"))
