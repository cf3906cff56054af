"""The serial procedure on scores worked out as they are asked for, a session in a task.

For sessions whose pairs are too many to be listed but whose rows, counted first, fit into a task. Ledger
rows that look alike are one class with a queue of ids, kept in the order of amounts. A statement row first
meets the classes of its day and amount, of its exact amount, and of its vendor and amount; for many rows at
once. Only what beats every class outside of these counts. A row that finds nothing there looks on alone: at
its close amounts and its day, then at its wide amounts, then at all classes, as far as what is left can
still beat what was found. No pair is kept, and none that could be best is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType, TimestampType

from ledgerloom.matching.scoring import SIDE_COLUMNS, Deployed

SID = "session_id"
# Levels of texts kept for later rows with the same text, in bytes.
KEPT_LEVELS = 64_000_000
# Statement rows, pairs of one row and pairs in all that are looked at together.
ROWS_AT_ONCE, MOST_OF_A_ROW, PAIRS_AT_ONCE = 8192, 4096, 1_000_000
# So many amounts that are no finite numbers are met by every row at once.
MOST_ODD = 64
# Up to so many classes of wide amounts are looked at with the close ones.
FEW_CLASSES = 2048
# A statement text of so many rows is compared with all ledger texts before any pair.
FREQUENT = 16
# From so many ledger texts on, texts are found by their three-letter pieces.
MANY_TEXTS = 4096
# No id: the queue of a class has ended.
NONE_LEFT = np.iinfo(np.int64).max
# White space as the JVM knows it, which is not quite Python's.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def can_settle(led: DataFrame, stm: DataFrame, rules) -> bool:
    """Whether numpy works out the same scores: step scores of double amounts."""
    kinds = [df.schema[f"{letter}_amount"].dataType for df, letter in ((led, "l"), (stm, "s"))]
    dates = {df.schema[f"{letter}_date"].dataType for df, letter in ((led, "l"), (stm, "s"))}
    known = dates in ({DateType()}, {TimestampType()})
    return isinstance(rules, Deployed) and kinds == [DoubleType()] * 2 and known


def settle_whole(led: DataFrame, stm: DataFrame, rules: Deployed) -> DataFrame:
    """Held pairs (session_id, led, stmt, score) of sessions that have rows on both sides."""
    kind = led.schema[SID].dataType
    names = [SID, "led", "stmt", "score"]
    schema = StructType([StructField(n, k) for n, k in zip(names, (kind, LongType(), LongType(), DoubleType()))])

    def run(rows: pa.Table) -> pa.Table:
        found = _serial(*_sides(rows), rules)
        sessions = pa.repeat(rows[SID][0], len(found[0]))
        return pa.table([sessions, *(pa.array(f, t) for f, t in zip(found, (pa.int64(), pa.int64(), pa.float64())))], names)

    return _by_session(led, stm).applyInArrow(run, schema)


def matched_rows(led: DataFrame, stm: DataFrame, rules: Deployed) -> DataFrame:
    """The same pairs with the columns of both rows, which the task has at hand: no table is joined again."""
    sides = [(f"{letter}_{c}", df.schema[f"{letter}_{c}"].dataType) for df, letter in ((led, "l"), (stm, "s")) for c in SIDE_COLUMNS]
    kinds = [(SID, led.schema[SID].dataType), ("led", LongType()), ("stmt", LongType()), *sides]
    schema = StructType([StructField(*k) for k in kinds])

    def run(rows: pa.Table) -> pa.Table:
        led, stm = _sides(rows)
        mine, theirs = _every_row(led, stm, *_serial(led, stm, rules)[:2])
        columns = [mine[SID], mine["id"], theirs["id"]]
        columns += [df[c] for df in (mine, theirs) for c in SIDE_COLUMNS]
        return pa.table(columns, [k for k, _ in kinds])

    return _by_session(led, stm).applyInArrow(run, schema)


def _by_session(led: DataFrame, stm: DataFrame):
    # So many partitions that few sessions share one; a given number is not merged again.
    tasks = max(int(led.sparkSession.conf.get("spark.sql.shuffle.partitions")), 200)
    rows = _side(led, "l", "led").unionByName(_side(stm, "s", "stmt"))
    return rows.repartition(tasks, SID).groupBy(SID)


def _side(df: DataFrame, letter: str, key: str) -> DataFrame:
    columns = (F.col(f"{letter}_{c}").alias(c) for c in SIDE_COLUMNS)
    return df.where(F.col(key).isNotNull() & F.col(SID).isNotNull()).select(
        SID, F.lit(letter == "l").alias("ledger"), F.col(key).alias("id"), *columns
    )


def _sides(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Ledger and statement rows, each in the order of their ids."""
    return tuple(rows.filter(mask).sort_by("id") for mask in (rows["ledger"], pc.invert(rows["ledger"])))


def _every_row(led: pa.Table, stm: pa.Table, led_ids: list, stmt_ids: list) -> tuple[pa.Table, pa.Table]:
    """The rows of the pairs; an id that several rows have brings each of them."""
    at = []
    for side, ids in ((led, led_ids), (stm, stmt_ids)):
        there = side["id"].to_numpy()
        at.append((np.searchsorted(there, ids), np.searchsorted(there, ids, "right")))
    (a, b), (c, d) = at
    pair, mine = _spread(a, b)
    again, theirs = _spread(c[pair], d[pair])
    return led.take(mine[again]), stm.take(theirs)


def _spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range and place, for every place in ranges of places."""
    n = end - first
    before = np.cumsum(n) - n
    return np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(before - first, n)


class _Texts:
    """The different texts of both sides in one column, and how they are related."""

    def __init__(self, led: pa.ChunkedArray, stm: pa.ChunkedArray, with_words: bool):
        (self.codes, self.texts), (self.asked, self.asking) = _coded(led), _coded(stm)
        self.at = {t: k for k, t in enumerate(self.texts)}
        # The ledger's code of each text of the statement, or -1.
        self.same = np.array([self.at.get(t, -1) for t in self.asking], np.int64)
        self.joined = "\0".join(self.texts)
        self.ends = np.cumsum([len(t) + 1 for t in self.texts], dtype=np.int64)
        self.lengths = sorted(set(map(len, self.texts)))
        self.words, self.with_word, self.pieces = None, {}, None
        if with_words:
            self.words, listed = [], defaultdict(list)
            for k, t in enumerate(self.texts):
                self.words.append(tuple({w: None for w in _SPACE.split(t) if w}))
                for w in self.words[-1]:
                    listed[w].append(k)
            self.with_word = {w: np.array(k) for w, k in listed.items()}
        self.kept, self.scaled, self.pairs = {}, {}, {}

    def levels(self, k: int) -> np.ndarray:
        """Per ledger text, 3 equal to the statement's text ``k``, 2 one contains the other, 1 a shared word, 0 else.

        A last nought is for rows without text.
        """
        if k not in self.kept:
            if (len(self.kept) + 1) * len(self.texts) > KEPT_LEVELS:
                self.kept.clear()
            out = np.zeros(len(self.texts) + 1, np.int8)
            if k >= 0 and self.texts:
                text = self.asking[k]
                if self.words is not None:
                    for w in _SPACE.split(text):
                        if w in self.with_word:
                            out[self.with_word[w]] = 1
                out[self._holding(text)] = 2
                out[self._held(text)] = 2
                if self.same[k] >= 0:
                    out[self.same[k]] = 3
            self.kept[k] = out
        return self.kept[k]

    def coded(self, k: int, times: int) -> tuple[np.ndarray, int]:
        """The levels that were met, times a number, and the highest of them."""
        if k not in self.scaled:
            levels = self.levels(k)
            if (len(self.scaled) + 1) * len(self.texts) > KEPT_LEVELS:
                self.scaled.clear()
            steps = levels.view(np.uint8)
            if self.words is None:
                # There is no level of shared words.
                steps = steps - (steps > 0)
            self.scaled[k] = steps * np.uint8(times), int(levels.max(initial=0))
        return self.scaled[k]

    def level_of_pairs(self, k: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The same level for pairs of texts, each worked out once."""
        n = len(self.texts) + 1
        different, back = np.unique(k * n + other, return_inverse=True)
        if len(self.pairs) > 200_000:
            self.pairs.clear()
        return np.array([self._level(p, n) for p in different.tolist()], np.int8)[back]

    def _level(self, pair: int, n: int) -> int:
        if pair not in self.pairs:
            k, other = divmod(pair, n)
            a, b = self.asking[k], self.texts[other]
            if a == b:
                level = 3
            elif a in b or b in a:
                level = 2
            else:
                level = int(self.words is not None and not set(_SPACE.split(a)).isdisjoint(self.words[other]))
            self.pairs[pair] = level
        return self.pairs[pair]

    def _holding(self, text: str) -> list[int] | np.ndarray:
        """Texts that contain ``text``."""
        if not text:
            return list(range(len(self.texts)))
        if len(self.texts) >= MANY_TEXTS and len(text) >= 3:
            return [k for k in self._with_pieces(text).tolist() if text in self.texts[k]]
        found, place = [], self.joined.find(text)
        while place >= 0:
            k = int(np.searchsorted(self.ends, place, "right"))
            # A find that reaches into the next text is none.
            inside = place + len(text) < self.ends[k]
            if inside:
                found.append(k)
            place = self.joined.find(text, int(self.ends[k]) if inside else place + 1)
        return found

    def _with_pieces(self, text: str) -> np.ndarray:
        """Texts that have the two rarest three-letter pieces of ``text``."""
        if self.pieces is None:
            keys = _pieces(self.joined)
            inside = np.repeat(np.arange(len(self.ends), dtype=np.int32), np.diff(self.ends, prepend=0))[: len(keys)]
            order = np.argsort(keys, kind="stable")
            self.pieces = keys[order], inside[order]
        keys, inside = self.pieces
        wanted = _pieces(text)
        first, end = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
        rarest, *more = np.argsort(end - first)[:2]
        found = inside[first[rarest] : end[rarest]]
        for k in more if len(found) else ():
            # Both lists are in order.
            others = inside[first[k] : end[k]]
            found = found[others[np.minimum(np.searchsorted(others, found), len(others) - 1)] == found]
        return found[np.diff(found, prepend=-1) > 0]

    def _held(self, text: str) -> list[int]:
        """Texts that ``text`` contains."""
        n = len(text)
        lengths = self.lengths[: bisect_left(self.lengths, n + 1)]
        if sum(n + 1 - m for m in lengths) < len(self.texts):
            parts = {text[a : a + m] for m in lengths for a in range(n + 1 - m)}
            return [self.at[p] for p in parts if p in self.at]
        return [k for k, t in enumerate(self.texts) if t in text]

    def points(self, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text of the statement, and none, the most points of any ledger text, and of those not equal.

        ``levels`` has the points of the levels. Rare texts get what a contained text could bring.
        """
        best = np.maximum.accumulate(levels)
        alike = np.full(len(self.asking) + 1, best[2] if self.texts else 0.0)
        alike[-1] = 0.0
        often = np.bincount(self.asked[self.asked >= 0], minlength=len(self.asking))
        for k in np.flatnonzero(often >= FREQUENT).tolist():
            own = self.levels(k)
            alike[k] = best[own[own < 3].max(initial=0)]
        most = alike.copy()
        equal = np.flatnonzero(self.same >= 0)
        most[equal] = np.maximum(alike[equal], levels[3])
        return most, alike


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """Numbers of the texts, -1 for none, and the texts."""
    encoded = column.combine_chunks().dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()


def _pieces(text: str) -> np.ndarray:
    """Every three letters that follow one another, as a number that few of them share."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = letters[:-2] * np.uint32(7919) + letters[1:-1] * np.uint32(127) + letters[2:]
    return (mixed ^ mixed >> np.uint32(16)).astype(np.uint16)


def _numbers(column: pa.ChunkedArray, nothing) -> tuple[np.ndarray, np.ndarray]:
    there = column.is_valid().to_numpy()
    return there, column.combine_chunks().fill_null(nothing).to_numpy(zero_copy_only=False)


def _serial(led: pa.Table, stm: pa.Table, rules: Deployed) -> tuple[list, list, list]:
    """Ledger ids, statement ids and scores: statement rows in the order of their ids, each with its best free row."""
    if not (len(led) and len(stm)):
        return [], [], []
    with np.errstate(all="ignore"):
        return _Session(led, stm, rules).run()


class _Session:
    """Classes of free ledger rows by amount, and the statement rows that choose among them."""

    def __init__(self, led: pa.Table, stm: pa.Table, rules: Deployed):
        self.rules = rules
        self.exact, self.close, self.wide = rules.amount_points
        self.same_day, self.other_day = rules.date_points
        self.vendor_points = np.array([0.0, *rules.vendor_points[::-1]])
        self.description_points = np.array([0.0, 0.0, *rules.description_points[::-1]])
        # Every score there is by its levels (amount, date, vendor, description), and the scores in order.
        days = np.array([0.0, self.other_day, self.same_day])
        amounts = np.array([0.0, self.wide, self.close, self.exact])
        scores = ((amounts[:, None] + days)[..., None] + self.vendor_points)[..., None] + self.description_points[[0, 2, 3]]
        self.scores, ranks = np.unique(scores, return_inverse=True)
        self.ranks = ranks.ravel().astype(np.uint8) + np.uint8(1)
        self.vendors = _Texts(led["vendor"], stm["vendor"], with_words=True)
        # A description without characters is none.
        filled = [pc.if_else(pc.equal(df["description"], ""), pa.scalar(None, pa.string()), df["description"]) for df in (led, stm)]
        self.described = _Texts(*filled, with_words=False)
        self._read_statement(stm, led)
        self._read_ledger(led)
        self._bounds()

    def _read_statement(self, stm: pa.Table, led: pa.Table) -> None:
        days = [pc.cast(pc.cast(df["date"], pa.int32()) if pa.types.is_date32(df["date"].type) else df["date"], pa.int64()) for df in (led, stm)]
        (self.led_dated, led_day), (self.dated, day) = (_numbers(d, 0) for d in days)
        known, codes = np.unique(led_day[self.led_dated], return_inverse=True)
        self.led_day = np.full(len(led), -1)
        self.led_day[self.led_dated] = codes
        at = np.searchsorted(known, day)
        found = self.dated & (at < len(known))
        found[found] = known[at[found]] == day[found]
        # A day the ledger does not have is -2.
        self.day = np.where(found, at, np.where(self.dated, -2, -1))
        self.has_amount, self.amount = _numbers(stm["amount"], 0.0)
        # Only finite amounts have neighbours in order; others look at all classes.
        self.ordered = self.has_amount & np.isfinite(self.amount)
        ids = stm["id"].to_numpy()
        self.numbers, self.firsts = np.unique(ids, return_index=True)
        self.firsts = np.r_[self.firsts, len(ids)]

    def _read_ledger(self, led: pa.Table) -> None:
        ids = led["id"].to_numpy()
        has, amount = _numbers(led["amount"], 0.0)
        kind = np.where(has, np.where(np.isfinite(amount), 0, 1), 2)
        keys = [self.described.codes, self.vendors.codes, self.led_day, amount.view(np.int64), amount, kind]
        order = np.lexsort([ids, *keys])
        new = np.zeros(len(order), bool)
        new[0] = True
        for k in (kind, amount.view(np.int64), self.led_day, self.vendors.codes, self.described.codes):
            new[1:] |= k[order][1:] != k[order][:-1]
        first = np.flatnonzero(new)
        top = order[first]
        self.queue, self.at, self.end = ids[order].tolist(), first.tolist(), np.r_[first[1:], len(order)].tolist()
        self.heads = ids[top]
        self.head = self.heads.tolist()
        # Rows of one id are one row, in whatever classes they are.
        self.twins, self.gone = {}, set()
        again = np.isin(ids, ids[1:][ids[1:] == ids[:-1]])
        if again.any():
            number = np.cumsum(new) - 1
            for i, c in zip(ids[order][again[order]].tolist(), number[again[order]].tolist()):
                self.twins.setdefault(i, set()).add(c)
        self.number = np.arange(len(top))
        self.place = np.arange(len(top))
        self.live = np.ones(len(top), bool)
        self.dead = 0
        size = np.abs(amount[top])
        self.c = {
            "amount": amount[top],
            "close": np.maximum(self.rules.exact_amount, size * self.rules.close_share),
            "wide": size * self.rules.wide_share,
            "any": np.maximum(np.maximum(self.rules.exact_amount, size * self.rules.close_share), size * self.rules.wide_share),
            "has": has[top],
            # In SQL not-a-number is no more than itself.
            "odd": np.isnan(amount[top]),
            "day": self.led_day[top],
            "dated": (self.led_day[top] >= 0).astype(np.uint8) * np.uint8(12),
            "vendor": self.vendors.codes[top],
            "description": self.described.codes[top],
        }
        self.kind = kind[top]
        # The classes with a day, by it, and those with a vendor, each by amount then.
        self.orders = {name: np.lexsort((self.place, self.c[name])) for name in ("day", "vendor")}
        self.orders = {name: o[self.c[name][o] >= 0] for name, o in self.orders.items()}
        self._limits()

    def _limits(self) -> None:
        self.finite, self.odd_end = np.searchsorted(self.kind, [1, 2]).tolist()
        self.sorted = self.c["amount"][: self.finite]
        self.width = len(self.number) + 1
        self.keys = {name: self.c[name][o] * self.width + o for name, o in self.orders.items()}

    def _drop_ended(self) -> None:
        """Leaves out the classes whose queue has ended."""
        keep, moved = self.live, np.cumsum(self.live) - 1
        self.orders = {name: moved[o[keep[o]]] for name, o in self.orders.items()}
        self.c = {name: v[keep] for name, v in self.c.items()}
        self.kind, self.number = self.kind[keep], self.number[keep]
        self.place[self.number] = np.arange(len(self.number))
        self.live, self.dead = np.ones(len(self.number), bool), 0
        self._limits()

    def _bounds(self) -> None:
        """What a row of the statement can get at most from the classes it does not meet at once."""
        v_most, v_alike = self.vendors.points(self.vendor_points)
        e_most, _ = self.described.points(self.description_points)
        vendor, description = self.vendors.asked, self.described.asked
        self.v_alike = v_alike[vendor]
        on = np.where(self.dated, max(self.same_day, self.other_day, 0.0), 0.0)
        off = np.where(self.dated, max(self.other_day, 0.0), 0.0)
        near = np.where(self.has_amount, max(self.close, self.wide, 0.0), 0.0)
        # Of the same day and a wide amount, an exact amount, or the same vendor and a wide amount: met at once.
        beside = near + off + v_alike[vendor] + e_most[description]
        apart = 0.0 + on + v_most[vendor] + e_most[description]
        self.bound = np.maximum(beside, apart)
        # Not-a-number and infinite amounts are close to others, wherever they stand; a few are met at once.
        self.few_odd = self.odd_end - self.finite <= MOST_ODD
        self.bound[self.has_amount & ~(self.ordered & self.few_odd)] = np.inf
        self.e_most = np.where(description >= 0, max(0.0, *self.description_points), 0.0)

    def _window(self, value: np.ndarray | float, share: float) -> tuple:
        """Places of the classes within ``share`` of their amount, or the exact tolerance, of ``value``; rather more."""
        size, slack = np.abs(value), self.rules.exact_amount + 1e-9 * np.abs(value) + 1e-12
        if share >= 1:
            return np.zeros(np.shape(value), np.int64), np.full(np.shape(value), self.finite)
        up, down = size / (1 - share) - size + slack, size - size / (1 + share) + slack
        low = value - np.where(value >= 0, down, up)
        high = value + np.where(value >= 0, up, down)
        return np.searchsorted(self.sorted, low), np.searchsorted(self.sorted, high, "right")

    def _amounts(self, value, at) -> np.ndarray:
        """Points of amounts that both sides have."""
        c = self.c
        away = np.abs(value - c["amount"][at])
        a = np.where(away <= c["wide"][at], self.wide, 0.0)
        a[away <= c["close"][at]] = self.close
        a[c["odd"][at]] = self.close
        a[away <= self.rules.exact_amount] = self.exact
        a[~c["has"][at]] = 0.0
        return a

    def run(self) -> tuple[list, list, list]:
        self.led, self.stmt, self.score = [], [], []
        numbers, firsts, limit = self.numbers.tolist(), self.firsts.tolist(), self.bound.tolist()
        self.limit = limit
        self.columns = [c.tolist() for c in (self.amount, self.has_amount, self.dated, self.day)]
        self.v_tops, self.e_tops = (np.maximum.accumulate(p).tolist() for p in (self.vendor_points, self.description_points))
        threshold, start = self.rules.threshold, 0
        while start < len(numbers):
            if self.dead * 8 > len(self.live):
                self._drop_ended()
            end, first, classes, scores = self._met(start)
            head = self.head
            for group in range(start, end):
                row, best = firsts[group], NONE_LEFT
                single = firsts[group + 1] == row + 1
                k, last = first[row - firsts[start]], first[row + 1 - firsts[start]] if single else -1
                while k < last:
                    # Of equal scores the smallest id.
                    x = scores[k]
                    while k < last and scores[k] == x:
                        if head[classes[k]] < best:
                            best, chosen = head[classes[k]], classes[k]
                        k += 1
                    if best != NONE_LEFT:
                        break
                if best == NONE_LEFT and not (single and limit[row] <= threshold):
                    x, chosen = self._alone(range(row, firsts[group + 1]))
                    if chosen >= 0 and x > threshold:
                        best = head[chosen]
                if best != NONE_LEFT:
                    self.led.append(best)
                    self.stmt.append(numbers[group])
                    self.score.append(x)
                    self._take(chosen, best)
            start = end
        return self.led, self.stmt, self.score

    def _take(self, c: int, number: int) -> None:
        if number in self.twins:
            self.gone.add(number)
            for other in self.twins[number]:
                if self.head[other] == number:
                    self._advance(other)
        else:
            self._advance(c)

    def _advance(self, c: int) -> None:
        k, end = self.at[c] + 1, self.end[c]
        while k < end and self.queue[k] in self.gone:
            k += 1
        self.at[c] = k
        self.head[c] = self.heads[c] = self.queue[k] if k < end else NONE_LEFT
        if k == end:
            self.live[self.place[c]] = False
            self.dead += 1

    def _met(self, start: int) -> tuple[int, list, list, list]:
        """For the next groups of statement rows, the classes met at once that beat all others, best first.

        Returns the end of the groups, where each row's classes begin, and the classes and their scores.
        """
        end = min(start + ROWS_AT_ONCE, len(self.numbers))
        rows = slice(self.firsts[start], self.firsts[end])
        value, ordered = self.amount[rows], self.ordered[rows]
        finite = np.where(ordered, value, 0.0)
        low, high = self._window(finite, max(self.rules.wide_share, self.rules.close_share))
        ranges, spans = [self._window(finite, 0.0)], [self._window(finite, self.rules.close_share), (low, high)]
        for name, key in (("day", self.day[rows]), ("vendor", np.r_[self.vendors.same, -1][self.vendors.asked[rows]])):
            base = np.where(key >= 0, key, -1) * self.width
            ranges.append(tuple(np.searchsorted(self.keys[name], base + x) for x in (low, high)))
            spans.append(tuple(np.searchsorted(self.keys[name], base + x) for x in (0, self.width)))
        # Places of the classes that a row may look at alone.
        self.offset, self.spans = rows.start, [(a.tolist(), b.tolist()) for a, b in spans]
        odd = self.odd_end if self.few_odd else self.finite
        ranges.append((np.full(len(value), self.finite), np.full(len(value), odd)))
        bound = np.maximum(self.bound[rows], self.rules.threshold)
        n = np.where(ordered & np.isfinite(bound), sum(b - a for a, b in ranges), 0)
        # A row that would meet very many looks on alone.
        for k in np.flatnonzero(n > MOST_OF_A_ROW).tolist():
            self.limit[rows.start + k], n[k] = np.inf, 0
        total = np.cumsum(n)[self.firsts[start + 1 : end + 1] - self.firsts[start] - 1]
        end = start + max(1, int(np.searchsorted(total, PAIRS_AT_ONCE, "right")))
        count = int(self.firsts[end] - self.firsts[start])
        who, at = [], []
        for (a, b), order in zip(ranges, (None, self.orders["day"], self.orders["vendor"], None)):
            w, p = _spread(a[:count], np.where(n[:count] > 0, b[:count], a[:count]))
            who.append(w)
            at.append(p if order is None else order[p])
        who, at = np.concatenate(who), np.concatenate(at)
        row = who + rows.start
        score = self._amounts(value[who], at)
        day, dated = self.day[row], self.dated[row]
        own = self.c["day"][at]
        score += np.where(dated & (own >= 0), np.where(own == day, self.same_day, self.other_day), 0.0)
        # Texts are compared only where the pair can still beat what it has to.
        v, e = self.vendors.asked[row], self.described.asked[row]
        equal = self.vendors.same[v] == self.c["vendor"][at] if len(self.vendors.asking) else np.zeros(len(at), bool)
        equal &= (v >= 0) & (self.c["vendor"][at] >= 0)
        most = np.where(equal, self.vendor_points[3], self.v_alike[row])
        hope = np.flatnonzero((score + most + self.e_most[row] > bound[who]) & self.live[at])
        who, at, score, v, e, equal = who[hope], at[hope], score[hope], v[hope], e[hope], equal[hope]
        score += self.vendor_points[_levels(self.vendors, v, self.c["vendor"][at], equal)]
        score += self.description_points[_levels(self.described, e, self.c["description"][at], np.zeros(len(at), bool))]
        good = np.flatnonzero(score > bound[who])
        good = good[np.lexsort((-score[good], who[good]))]
        first = np.searchsorted(who[good], np.arange(count + 1))
        return end, first.tolist(), self.number[at[good]].tolist(), score[good].tolist()

    def _alone(self, rows: range) -> tuple[float, int]:
        """Best score and its class of least id, for the rows of one id; looks on until nothing left can beat it."""
        top, least, chosen = 0, NONE_LEFT, -1
        c, scores = self.c, self.scores

        def look(at) -> None:
            """``at``: a slice or the places of classes."""
            nonlocal top, least, chosen
            code = self._amount_levels(value, at) if has_amount else np.zeros(len(c["dated"][at]), np.uint8)
            if dated:
                code += c["dated"][at]
                if day >= 0:
                    code += (c["day"][at] == day).view(np.uint8) * np.uint8(12)
            if v:
                code += v_levels[c["vendor"][at]]
            if e:
                code += e_levels[c["description"][at]]
            ranks = self.ranks[code]
            ranks *= self.live[at]
            most = int(ranks.max(initial=0))
            if most < top or not most:
                return
            numbers = self.number[at][ranks == most]
            ids = self.heads[numbers]
            k = int(ids.argmin())
            if most > top or ids[k] < least:
                top, least, chosen = most, int(ids[k]), int(numbers[k])

        def enough(rest: float) -> bool:
            """Whether rows of at most this score need not be looked at."""
            return rest <= self.rules.threshold or top > 0 and scores[top - 1] > rest

        for row in rows:
            value, has_amount, dated, day = (column[row] for column in self.columns)
            close, far, same_day, same_vendor = (slice(a[row - self.offset], b[row - self.offset]) for a, b in self.spans)
            v_levels, v, e_levels, e = *self.vendors.coded(int(self.vendors.asked[row]), 3), *self.described.coded(int(self.described.asked[row]), 1)
            v_most, e_most = self.v_tops[v], self.e_tops[e]
            off = max(self.other_day, 0.0) if dated else 0.0
            on = max(self.same_day, off) if day >= 0 else off
            wide = max(self.wide, 0.0)
            if not has_amount or self.ordered[row]:
                if has_amount:
                    few = far.stop - far.start <= FEW_CLASSES
                    look(far if few else close)
                    if self.odd_end > self.finite:
                        look(slice(self.finite, self.odd_end))
                    if few:
                        wide = 0.0
                    if enough(wide + on + v_most + e_most):
                        continue
                if day >= 0:
                    look(self.orders["day"][same_day])
                if has_amount and not few:
                    if enough(wide + off + v_most + e_most):
                        continue
                    look(far)
                if enough(0.0 + off + v_most + e_most):
                    continue
                if v == 3:
                    look(self.orders["vendor"][same_vendor])
                    if enough(0.0 + off + self.v_tops[2] + e_most):
                        continue
            look(slice(0, len(self.number)))
        return (float(scores[top - 1]) if top else 0.0), chosen

    def _amount_levels(self, value: float, at) -> np.ndarray:
        """36 times the level of the amounts: 3 exact, 2 close, 1 wide, 0 else."""
        c = self.c
        away = np.abs(value - c["amount"][at])
        level = (away <= c["any"][at]).view(np.uint8) + (away <= c["close"][at])
        level += away <= self.rules.exact_amount
        if isinstance(at, np.ndarray) or at.stop > self.finite:
            level[c["odd"][at]] = 2
            level *= c["has"][at]
        level *= np.uint8(36)
        return level


def _levels(texts: _Texts, asked: np.ndarray, there: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Levels of pairs of texts by their numbers; those known to be equal are not compared."""
    out = np.where(equal, 3, 0).astype(np.int8)
    open_pairs = np.flatnonzero(~equal & (asked >= 0) & (there >= 0))
    if len(open_pairs):
        out[open_pairs] = texts.level_of_pairs(asked[open_pairs], there[open_pairs])
    return out
