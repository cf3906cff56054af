"""Candidate pairs without comparing every statement row with every ledger row.

Small sessions pair each statement row with the few ledger rows of its session.
In large sessions pairs come from equi-joins on blocking keys, in two phases:
a tight one that only has to find the pairs whose score is above its cut, and a
loose one for the rows still without a partner.

Inside a phase each group of ledger rows that look alike to a block shows only
its first few rows by id. A statement row may use its candidates down to the
point where a group was cut (its frontier), so nothing is ever skipped; if that
is not enough it asks again and sees more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.similarity import most_similar, sequence_ratio, word_jaccard
from ledgerloom.matching.scoring import ROW_COLUMNS, SIDE_COLUMNS, Deployed, Graded

ALL = ("l_amount", "l_date", "l_vendor", "l_description")
DATED = ("l_date", "l_vendor", "l_description")
TEXT = ("l_vendor", "l_description")
KEY = ("k0",)
SID = "session_id"
# Strings that are more alike than this share a word or two neighbouring letters.
LEAST_FLOOR = 0.7


@dataclass(frozen=True)
class Block:
    """Pairs that agree on ``keys``; ``group`` holds the rows that look alike to a statement row.

    ``ceiling`` is the best score of a row of the group that was not shown: that
    of the pair itself, of its texts alone, of its texts and date, or a number.
    """

    keys: tuple[str, ...]
    group: tuple[str, ...]
    ceiling: str | float


@dataclass(frozen=True)
class Phase:
    blocks: tuple[Block, ...]
    cut: float | None = None


# Every statement row with every group of its session's look-alike ledger rows. Only for
# profiles whose threshold the blocks do not reach, and only for rows left by the blocks.
EVERYTHING = Phase((Block((), ALL, "pair"),), None)


@dataclass
class Plan:
    """Phases of a profile and the dictionaries of related texts they need."""

    profile: Deployed | Graded
    phases: list[Phase]
    shares: dict[str, tuple[float, float]]
    vendors: DataFrame | None = None
    descriptions: DataFrame | None = None


def plan_for(profile: Deployed | Graded) -> Plan:
    return _deployed_plan(profile) if isinstance(profile, Deployed) else _graded_plan(profile)


def pair_sessions(statement: DataFrame, ledger: DataFrame, profile) -> DataFrame:
    """Accepted pairs of sessions whose number of pairs is known to be small."""
    pairs = statement.join(ledger, SID)
    scored = profile.add_scores(pairs, hopeful_only=True)
    return scored.where(profile.accepts(F.col("score"))).select(SID, "stmt", "led", "score")


def phase_edges(
    plan: Plan, number: int, statement: DataFrame, ledger: DataFrame, shown: int
) -> DataFrame:
    """Edges of one phase: session_id, stmt, led, score, and ``cut_off`` per statement row.

    ``ledger`` holds the rows some statement row can still take, with ``held``
    telling whether one already has it. Rows with a null ``led`` only say that
    the statement row was cut off before its first candidate.
    """
    profile, phase = plan.profile, plan.phases[number]
    parts = []
    for block in phase.blocks:
        if block.ceiling == "text":
            pairs = _by_texts(statement, ledger, block, plan, shown)
        else:
            names = [SID, *(f"k{i}" for i in range(len(block.keys)))]
            pairs = _keyed(statement, block, "s", plan).join(_visible(ledger, block, plan, shown), names)
        parts.append(
            pairs.select(
                SID, "stmt", "led", "last", F.lit(str(block.ceiling)).alias("ceiling"),
                *(f"{side}_{c}" for side in "sl" for c in SIDE_COLUMNS + ROW_COLUMNS),
            )
        )
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    scored = profile.add_scores(pairs)

    above = profile.accepts if phase.cut is None else (lambda c: c > phase.cut)
    bound = _bound(profile)
    scored = scored.withColumn("_bound", F.when(F.col("last"), bound))
    # Per pair first: it may come out of several blocks.
    single = scored.groupBy(SID, "stmt", "led").agg(
        F.max("score").alias("score"),
        F.max(F.when(above(F.col("_bound")), F.struct(F.col("_bound").alias("b"), (-F.col("led")).alias("n")))).alias("f"),
    )
    frontier = single.groupBy(SID, "stmt").agg(F.max("f").alias("frontier"))
    position = F.struct(F.col("score").alias("b"), (-F.col("led")).alias("n"))
    edges = single.drop("f").join(frontier, [SID, "stmt"])
    usable = above(F.col("score")) & (F.col("frontier").isNull() | (position >= F.col("frontier")))
    return edges.select(
        SID,
        "stmt",
        F.when(usable, F.col("led")).alias("led"),
        F.when(usable, F.col("score")).alias("score"),
        F.col("frontier").isNotNull().alias("cut_off"),
    ).where(F.col("led").isNotNull() | F.col("cut_off"))


def _bound(profile) -> Column:
    """Best possible score of the rows of the same group that were not shown."""
    zero = F.lit(0.0)
    if isinstance(profile, Deployed):
        base = F.when(F.col("s_date").isNotNull(), profile.date_points[1]).otherwise(0.0)
        total = profile.total
    else:
        base = zero
        total = lambda a, d, v, e: profile.rank(profile.total(a, d, v, e))
    c = F.col
    return (
        F.when(c("ceiling") == "pair", c("score"))
        .when(c("ceiling") == "text", total(zero, base, c("v"), c("e")))
        .when(c("ceiling") == "dated", total(zero, c("d"), c("v"), c("e")))
        .otherwise(c("ceiling").try_cast("double"))
    )


def _by_texts(statement: DataFrame, ledger: DataFrame, block: Block, plan: Plan, shown: int) -> DataFrame:
    """Pairs of a block that looks at texts only, a bounded list for each different pair of texts.

    Statement rows with the same texts rank the block's rows alike as far as texts go, so the best
    ``shown`` rows, free and held ones apart, are found once for all of them. What was cut is no better
    than the last row of the list.
    """
    texts = [SID, "s_vendor", "s_description"]
    unknown = {"s_amount": "double", "s_date": "date"}
    classes = plan.profile.with_words(statement.select(*texts).distinct(), "s_")
    classes = classes.withColumns({c: F.lit(None).cast(t) for c, t in unknown.items()})
    names = [SID, *(f"k{i}" for i in range(len(block.keys)))]
    rows = _keyed(_shown(ledger, block.group, shown, keep=("held",)), block, "l", plan)
    # A shared word may bring a pair more than once.
    met = _keyed(classes, block, "s", plan).join(rows, names).dropDuplicates([*texts, "led"])
    rated = plan.profile.add_scores(met).drop(*unknown, "s_words")
    own = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c != SID else F.col(c) == F.col(f"_{c}") for c in texts]
    order = Window.partitionBy(*texts, "held").orderBy(F.desc(_text_score(plan.profile)), "led")
    ranked = rated.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= shown)
    lists = ranked.withColumn("last", F.col("last") | (F.col("_r") == shown)).drop("a", "d", "v", "e", "score", "_r", "held")
    lists = lists.withColumnsRenamed({c: f"_{c}" for c in texts})
    return statement.join(lists, own[0] & own[1] & own[2]).drop(*(f"_{c}" for c in texts))


def _text_score(profile) -> Column:
    """What a pair's texts alone are worth, in the order of ``_bound``."""
    zero = F.lit(0.0)
    total = profile.total(zero, zero, F.col("v"), F.col("e"))
    return total if isinstance(profile, Deployed) else profile.rank(total)


def _visible(ledger: DataFrame, block: Block, plan: Plan, shown: int) -> DataFrame:
    """Keyed rows of a block, each group cut after its first ``shown`` rows.

    Groups made of row values are cut before the keys are added, so the blocks
    that share a grouping share one shuffle.
    """
    if block.group == KEY:
        return _shown(_keyed(ledger, block, "l", plan), KEY, shown)
    return _keyed(_shown(ledger, block.group, shown), block, "l", plan)


def _shown(rows: DataFrame, group: tuple[str, ...], shown: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """First rows by id of every group, free and held ones apart; the rank prunes before the shuffle."""
    w = Window.partitionBy(SID, *group, "held").orderBy("led")
    ranked = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= shown)
    return ranked.withColumn("last", F.col("_r") == shown).drop(*{"_r", "held"}.difference(keep))


def _keyed(df: DataFrame, block: Block, side: str, plan: Plan) -> DataFrame:
    for i, key in enumerate(block.keys):
        df = _with_key(df, key, f"k{i}", side, plan)
    return df


def _with_key(df: DataFrame, key: str, out: str, side: str, plan: Plan) -> DataFrame:
    name, _, level = key.partition(":")
    if name == "amount":
        share, tolerance = plan.shares[level]
        return df.withColumn(out, F.explode(amount_cells(F.col(f"{side}_amount"), share, tolerance, side == "s")))
    if name == "date":
        return df.withColumn(out, F.col(f"{side}_date")).where(F.col(out).isNotNull())
    if name == "near":
        days = int(level)
        day = F.col(f"{side}_date")
        if side == "l":
            return df.withColumn(out, day).where(F.col(out).isNotNull())
        return df.withColumn(out, F.explode(F.sequence(F.date_sub(day, days), F.date_add(day, days))))
    if name == "word":
        return df.withColumn(out, F.explode(text.word_set(F.col(f"{side}_vendor"))))
    if name == "same_description":
        return df.withColumn(out, F.col(f"{side}_description")).where(F.length(out) > 0)
    column = f"{side}_{name}"
    if side == "l":
        return df.withColumn(out, F.col(column)).where(F.col(out).isNotNull())
    related = plan.vendors if name == "vendor" else plan.descriptions
    return df.join(related.select(SID, F.col("s").alias(column), F.col("l").alias(out)), [SID, column])


def amount_cells(amount: Column, share: float, tolerance: float, spread: bool) -> Column:
    """Cells such that amounts within tolerance always meet in one.

    Logarithmic cells cover a relative tolerance, linear ones an absolute
    tolerance near zero. The statement side (``spread``) also takes both
    neighbours of its cell.
    """
    size = F.abs(amount)
    step = tolerance * 1.1
    linear = F.floor(amount / F.lit(step)).cast("long")
    cells = []
    if share > 0:
        width = -math.log(1.0 - share) * 1.01
        small = tolerance / share * 1.25 + (tolerance if spread else 0.0)
        log = F.when(size > 0, F.floor(F.ln(size) / F.lit(width)).cast("long"))
        sign = F.signum(amount).cast("int")
        cells.append((sign, log, log.isNotNull()))
        cells.append((F.lit(0), linear, size <= small))
    else:
        cells.append((F.lit(0), linear, linear.isNotNull()))
    near = (-1, 0, 1) if spread else (0,)
    return F.array_compact(
        F.array(
            *(
                F.when(present, F.struct(kind.alias("t"), (cell + F.lit(step_by)).alias("i")))
                for kind, cell, present in cells
                for step_by in near
            )
        )
    )


def contained_pairs(statement: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pairs (session_id, s, l) of texts where one contains the other.

    A contained text shares all its three-letter pieces with the other, so it
    is looked up by its rarest piece; texts of up to three letters are pieces
    themselves.
    """
    forward = _inside(statement.withColumnRenamed("s", "x"), ledger.withColumnRenamed("l", "y"))
    backward = _inside(ledger.withColumnRenamed("l", "x"), statement.withColumnRenamed("s", "y"))
    return (
        forward.select(SID, F.col("x").alias("s"), F.col("y").alias("l"))
        .unionByName(backward.select(SID, F.col("y").alias("s"), F.col("x").alias("l")))
        .distinct()
    )


def _pieces(col: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(col) - (n - 1))
    return F.when(
        F.length(col) >= n, F.array_distinct(F.transform(starts, lambda i: F.substr(col, i, F.lit(n))))
    ).otherwise(F.array().cast("array<string>"))


def _inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    y = F.col("y")
    pieces = F.concat(F.array(F.lit("")), _pieces(y, 1), _pieces(y, 2), _pieces(y, 3))
    table = outer.select(SID, "y", F.explode(pieces).alias("piece"))
    counts = table.groupBy(SID, "piece").agg(F.count(F.lit(1)).alias("n"))
    x = F.col("x")
    own = F.when(F.length(x) <= 3, F.array(x)).otherwise(_pieces(x, 3))
    rarest = (
        inner.select(SID, "x", F.explode(own).alias("piece"))
        .join(counts, [SID, "piece"], "left")
        .groupBy(SID, "x")
        .agg(F.min_by("piece", F.coalesce("n", F.lit(0))).alias("piece"))
    )
    return rarest.join(table, [SID, "piece"]).where(F.col("y").contains(F.col("x"))).select(SID, "x", "y")


def fuzzy_pairs(statement: DataFrame, ledger: DataFrame, floor: float) -> DataFrame:
    """Pairs (session_id, s, l) of vendors whose graded score can reach ``floor``.

    Strings that similar share a word or two neighbouring letters, very short
    ones a letter; containment is found separately.
    """
    if floor <= LEAST_FLOOR:
        raise ValueError("similar vendors are looked up only above a ratio of 0.7")
    short = int(2 / (3 * floor - 2))

    def grams(df: DataFrame, name: str) -> DataFrame:
        col = F.col(name)
        letters = F.when(F.length(col) <= short, _pieces(col, 1)).otherwise(F.array().cast("array<string>"))
        both = F.array_distinct(F.concat(_pieces(col, 2), letters, text.word_set(col)))
        return df.where(F.length(col) > 0).select(SID, name, F.explode(both).alias("gram"))

    meets = (
        grams(statement, "s")
        .join(grams(ledger, "l"), [SID, "gram"])
        .where(_may_reach("s", "l", floor))
        .select(SID, "s", "l")
        .distinct()
    )
    near = most_similar(F.col("l"), F.col("s")) >= floor
    rated = meets.withColumn("ratio", sequence_ratio(near, F.col("l"), F.col("s")))
    jaccard = word_jaccard(text.word_set(F.col("l")), text.word_set(F.col("s")))
    alike = F.coalesce(F.col("ratio") >= floor, F.lit(False)) | (jaccard >= floor)
    similar = rated.where(alike).select(SID, "s", "l")
    filled = lambda df, n: df.where(F.length(n) > 0)
    return similar.unionByName(contained_pairs(filled(statement, "s"), filled(ledger, "l"))).distinct()


def _may_reach(a: str, b: str, floor: float) -> Column:
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    lengths = shorter * 2.0 / (shorter + longer) >= floor
    return lengths | (word_jaccard(text.word_set(F.col(a)), text.word_set(F.col(b))) >= floor)


# What a block needs of a pair, as least levels of (amount, date, vendor, description):
# amount 3 exact, 2 close, 1 wide; date 2 equal, 1 both known; vendor 3 equal,
# 2 contained, 1 shared word; description 2 equal, 1 contained.
_NEEDS = {
    "amount:exact": (3, 0, 0, 0),
    "amount:close": (2, 0, 0, 0),
    "amount:wide": (1, 0, 0, 0),
    "date": (0, 2, 0, 0),
    "vendor": (0, 0, 2, 0),
    "word": (0, 0, 1, 0),
    "description": (0, 0, 0, 1),
    "same_description": (0, 0, 0, 2),
}


def _deployed_plan(profile: Deployed) -> Plan:
    exact, close, wide = profile.amount_points
    other = profile.date_points[1]
    by_amount = [Block(("amount:wide", k), ALL, "pair") for k in ("date", "vendor", "word", "description")]
    by_date = [Block(("date", k), DATED, "dated") for k in ("vendor", "word", "same_description")]
    by_text = [Block(("vendor",), TEXT, "text"), Block(("word", "same_description"), TEXT, "text")]
    by_cell = [
        Block(("amount:exact",), ("l_amount",), exact + other),
        Block(("amount:close",), KEY, close + other),
        Block(("amount:wide",), KEY, wide + other),
    ]
    phases = [by_amount[:2], [*by_amount, *by_date, *by_text, *by_cell]]
    levels = {
        0: (0.0, wide, close, exact),
        1: (0.0, other, profile.date_points[0]),
        2: (0.0, *reversed(profile.vendor_points)),
        3: (0.0, *reversed(profile.description_points)),
    }
    combos = [
        (c, levels[0][c[0]] + levels[1][c[1]] + levels[2][c[2]] + levels[3][c[3]])
        for c in product(range(4), range(3), range(4), range(3))
    ]
    out = []
    for blocks in phases:
        missed = [
            score
            for combo, score in combos
            if score > profile.threshold and not any(_covers(b, combo) for b in blocks)
        ]
        out.append(Phase(tuple(blocks), max(missed) if missed else None))
    if out[-1].cut is not None:
        # So low a threshold accepts rows with next to nothing in common.
        out.append(EVERYTHING)
    tolerance = profile.exact_amount
    shares = {
        "exact": (0.0, tolerance),
        "close": (profile.close_share, tolerance),
        "wide": (profile.wide_share, tolerance),
    }
    return Plan(profile, out, shares)


def _covers(block: Block, combo: tuple[int, ...]) -> bool:
    return all(have >= need for key in block.keys for have, need in zip(combo, _NEEDS[key]))


def _graded_plan(profile: Graded) -> Plan:
    w = profile.date_window_days
    wa, wd, wv, we = profile.weights
    steps = profile.amount_steps[-1]
    share = profile.amount_share * steps
    # Relative to the mean of both amounts; the widest ratio between them.
    ratio = (1 - share / 2) / (1 + share / 2)
    tight = Block(("amount:wide", f"near:{w}"), ALL, "pair")
    loose = (
        Block(("amount:wide",), ALL, "pair"),
        Block((f"near:{2 * w}",), DATED, "dated"),
        Block(("vendor",), TEXT, "text"),
    )
    best_outside = max(wa + profile.far_date * wd + wv + we, wd + wv + we)
    reachable = profile.vendor_floor() > LEAST_FLOOR
    phases = [Phase((tight,), round(best_outside, 3)), Phase(loose, None) if reachable else EVERYTHING]
    return Plan(profile, phases, {"wide": (1 - ratio, profile.amount_tolerance * steps)})


def dictionaries(plan: Plan, statement: DataFrame, ledger: DataFrame) -> Plan:
    """Attach the tables of related vendors and descriptions, distinct texts only."""

    def texts(df: DataFrame, column: str, out: str) -> DataFrame:
        return df.select(SID, F.col(column).alias(out)).where(F.col(out).isNotNull()).distinct()

    s, led = texts(statement, "s_vendor", "s"), texts(ledger, "l_vendor", "l")
    if isinstance(plan.profile, Graded):
        if plan.profile.vendor_floor() > LEAST_FLOOR:
            plan.vendors = fuzzy_pairs(s, led, plan.profile.vendor_floor())
        return plan
    plan.vendors = contained_pairs(s, led)
    filled = [
        texts(df, c, n).where(F.length(n) > 0)
        for df, c, n in ((statement, "s_description", "s"), (ledger, "l_description", "l"))
    ]
    plan.descriptions = contained_pairs(*filled)
    return plan
