"""The two scoring profiles.

A pair of records carries the ledger side in ``l_*`` columns and the statement
side in ``s_*`` columns: amount, date, vendor and description in match form.
Each profile adds the four component scores ``a``, ``d``, ``v`` and ``e`` and the
``score`` that ranks candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.similarity import most_similar, sequence_ratio, word_jaccard, word_overlap
from ledgerloom.operators.clean import prepare_for_matching

SIDE_COLUMNS = ("amount", "date", "vendor", "description")
# What a profile works out once per row for its pairs.
ROW_COLUMNS = ("words",)

# Tier limits shared by both profiles.
HIGH = 0.85
MEDIUM = 0.65
# Advice per tier.
RECOMMENDATIONS = {
    "high": "Auto-approve: High confidence match",
    "medium": "Review recommended: Medium confidence match",
    "low": "Manual review required: Low confidence match",
}


def _c(name: str) -> Column:
    return F.col(name)


@dataclass(frozen=True)
class Deployed:
    """Step scores that add up to at most 1.0; a match needs more than the threshold."""

    # Points per level, and the tolerances that reach them.
    amount_points: tuple[float, float, float] = (0.4, 0.35, 0.2)
    exact_amount: float = 0.01
    close_share: float = 0.02
    wide_share: float = 0.05
    date_points: tuple[float, float] = (0.25, 0.15)
    vendor_points: tuple[float, float, float] = (0.25, 0.2, 0.1)
    description_points: tuple[float, float] = (0.1, 0.05)
    threshold: float = 0.3
    high: float = HIGH
    medium: float = MEDIUM

    def prepare(self, df: DataFrame, source: str) -> DataFrame:
        names = {
            n: text.upper_trim(_c(n)) if n in df.columns else F.lit(None).cast("string")
            for n in ("vendor", "description")
        }
        ready = df.select("session_id", "txn_id", "amount", "date", *(c.alias(n) for n, c in names.items()))
        return self.with_words(ready)

    def with_words(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Adds the words of the vendor."""
        return df.withColumn(f"{prefix}words", text.words(_c(f"{prefix}vendor")))

    def amount_score(self) -> Column:
        diff = F.abs(_c("s_amount") - _c("l_amount"))
        size = F.abs(_c("l_amount"))
        exact, close, wide = self.amount_points
        return (
            F.when(diff <= self.exact_amount, exact)
            .when(diff <= F.greatest(F.lit(self.exact_amount), size * self.close_share), close)
            .when(diff <= size * self.wide_share, wide)
            .otherwise(0.0)
        )

    def date_score(self) -> Column:
        same, other = self.date_points
        both = _c("s_date").isNotNull() & _c("l_date").isNotNull()
        return F.when(_c("s_date") == _c("l_date"), same).when(both, other).otherwise(0.0)

    def vendor_score(self) -> Column:
        same, part, word = self.vendor_points
        s, led = _c("s_vendor"), _c("l_vendor")
        shared = F.arrays_overlap(_c("s_words"), _c("l_words"))
        return (
            F.when(s == led, same)
            .when(s.contains(led) | led.contains(s), part)
            .when(shared, word)
            .otherwise(0.0)
        )

    def description_score(self) -> Column:
        same, part = self.description_points
        s, led = _c("s_description"), _c("l_description")
        filled = (F.length(s) > 0) & (F.length(led) > 0)
        return (
            F.when(filled & (s == led), same)
            .when(filled & (s.contains(led) | led.contains(s)), part)
            .otherwise(0.0)
        )

    def total(self, a: Column, d: Column, v: Column, e: Column) -> Column:
        return a + d + v + e

    def accepts(self, score: Column) -> Column:
        return score > self.threshold

    def add_scores(self, pairs: DataFrame, hopeful_only: bool = False) -> DataFrame:
        parts = pairs.withColumns(
            {
                "a": self.amount_score(),
                "d": self.date_score(),
                "v": self.vendor_score(),
                "e": self.description_score(),
            }
        )
        scored = parts.withColumn("score", self.total(_c("a"), _c("d"), _c("v"), _c("e")))
        return scored.where(self.accepts(_c("score"))) if hopeful_only else scored

    def match_type(self) -> Column:
        return (
            F.when(_c("score") >= self.high, "high").when(_c("score") >= self.medium, "medium").otherwise("low")
        )

    def reasons(self) -> Column:
        exact, close, wide = self.amount_points
        la, sa = _money("l_amount"), _money("s_amount")
        ld, sd = _day("l_date"), _day("s_date")
        lv, sv = _c("l_vendor"), _c("s_vendor")
        v_same, v_part, v_word = self.vendor_points
        e_same, e_part = self.description_points
        d_same, d_other = self.date_points
        # Wording of the reasons.
        return _listed(
            F.when(_c("a") == exact, _say("Exact amount match: $", la))
            .when(_c("a") == close, _say("Close amount match: $", la, " ≈ $", sa))
            .when(_c("a") == wide, _say("Approximate amount match: $", la, " ≈ $", sa)),
            F.when(_c("d") == d_same, _say("Exact date match: ", ld)).when(
                _c("d") == d_other, _say("Similar dates: ", ld, " ≈ ", sd)
            ),
            F.when(_c("v") == v_same, _say("Exact vendor match: ", lv))
            .when(_c("v") == v_part, _say("Partial vendor match: ", lv, " ≈ ", sv))
            .when(_c("v") == v_word, _say("Vendor keyword match: ", lv, " ≈ ", sv)),
            F.when(_c("e") == e_same, _say("Description match: ", _c("l_description"))).when(
                _c("e") == e_part, F.lit("Partial description match")
            ),
        )

    def discrepancies(self) -> Column:
        no_amount = _c("l_amount").isNull() | _c("s_amount").isNull()
        # Wording of the discrepancies.
        return _listed(
            F.when(no_amount, F.lit("Invalid amount data")).when(
                _c("a") == 0, _say("Amount difference: $", _money("l_amount"), " vs $", _money("s_amount"))
            ),
            F.when(_c("d") == 0, _say("Date difference: ", _day("l_date"), " vs ", _day("s_date"))),
            F.when(_c("v") == 0, _say("Vendor difference: ", _c("l_vendor"), " vs ", _c("s_vendor"))),
        )


@dataclass(frozen=True)
class Graded:
    """Weighted graded scores; a match needs the rounded sum to reach the threshold."""

    # Weights of amount, date, vendor and description.
    weights: tuple[float, float, float, float] = (0.4, 0.25, 0.25, 0.1)
    amount_tolerance: float = 0.01
    date_window_days: int = 3
    # Scores per amount level (tolerance, then 1, 3 and 5 scaled tolerances).
    amount_levels: tuple[float, float, float, float] = (1.0, 0.9, 0.7, 0.5)
    amount_share: float = 0.02
    amount_steps: tuple[int, int, int] = (1, 3, 5)
    date_decay: float = 0.3
    far_date: float = 0.5
    part_vendor: float = 0.9
    threshold: float = 0.3
    high: float = HIGH
    medium: float = MEDIUM

    def prepare(self, df: DataFrame, source: str) -> DataFrame:
        filled = df
        for n in ("vendor", "description"):
            if n not in df.columns:
                filled = filled.withColumn(n, F.lit(None).cast("string"))
        return self.with_words(prepare_for_matching(filled, source).select("session_id", "txn_id", *SIDE_COLUMNS))

    def with_words(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Adds the word set of the vendor."""
        return df.withColumn(f"{prefix}words", text.cleaned_words(_c(f"{prefix}vendor")))

    def amount_score(self) -> Column:
        diff = F.abs(_c("l_amount") - _c("s_amount"))
        mean = (F.abs("l_amount") + F.abs("s_amount")) / 2
        scale = F.greatest(F.lit(self.amount_tolerance), mean * self.amount_share)
        exact, near, mid, far = self.amount_levels
        one, three, five = self.amount_steps
        return (
            F.when(diff <= self.amount_tolerance, exact)
            .when(mean == 0, 0.0)
            .when(diff <= scale * one, near)
            .when(diff <= scale * three, mid)
            .when(diff <= scale * five, far)
            .otherwise(0.0)
        )

    def date_score(self) -> Column:
        days = F.abs(F.datediff("l_date", "s_date"))
        w = self.date_window_days
        return F.coalesce(
            F.when(days == 0, 1.0)
            .when(days <= w, F.lit(1.0) - (days / F.lit(w)) * self.date_decay)
            .when(days <= 2 * w, self.far_date),
            F.lit(0.0),
        )

    def total(self, a: Column, d: Column, v: Column, e: Column) -> Column:
        wa, wd, wv, we = self.weights
        return F.lit(0.0) + a * wa + d * wd + v * wv + e * we

    def rank(self, raw: Column) -> Column:
        return F.round(raw, 3)

    def accepts(self, score: Column) -> Column:
        return score >= self.threshold

    def vendor_floor(self) -> float:
        """Least vendor score that can carry a pair with neither amount nor date."""
        _, _, wv, we = self.weights
        return (self.threshold - 0.0005 - we) / wv

    def add_scores(self, pairs: DataFrame, hopeful_only: bool = False) -> DataFrame:
        """Scores of each pair, or only of those that can still be accepted.

        The sequence ratio leaves the JVM, so it is only asked for where the
        pair can still reach the threshold with the most its texts could give;
        hopeless pairs keep lower text scores, which changes no decision.
        """
        led, s = _c("l_vendor"), _c("s_vendor")
        parts = pairs.withColumns(
            {
                "a": self.amount_score(),
                "d": self.date_score(),
                "_plain": F.when(~_both_filled(led, s), 0.0)
                .when(led == s, 1.0)
                .when(led.contains(s) | s.contains(led), self.part_vendor),
            }
        )
        words = F.when(_c("_plain").isNull(), word_jaccard(_c("l_words"), _c("s_words")))
        parts = parts.withColumn("_words", words)
        most = F.coalesce("_plain", F.greatest(_c("_words"), most_similar(led, s)))
        parts = parts.withColumn("_most", most)
        best = self.rank(self.total(_c("a"), _c("d"), _c("_most"), F.lit(1.0)))
        parts = parts.withColumn("_hope", self.accepts(best))
        if hopeful_only:
            parts = parts.where("_hope")

        ld, sd = _c("l_description"), _c("s_description")
        open_text = _both_filled(ld, sd) & (ld != sd) & _c("_hope")
        ask_vendor = _c("_hope") & _c("_plain").isNull() & (_c("_most") > _c("_words"))
        parts = parts.withColumns(
            {"_vr": sequence_ratio(ask_vendor, led, s), "_er": sequence_ratio(open_text, ld, sd)}
        )
        # Different descriptions of one word each share none, which is seen without splitting them.
        single = ~(ld.contains(" ") | sd.contains(" "))
        overlap = F.when(single, 0.0).otherwise(word_overlap(text.cleaned_words(ld), text.cleaned_words(sd)))
        described = (
            F.when(~_both_filled(ld, sd), 0.0)
            .when(ld == sd, 1.0)
            .when(_c("_hope"), F.greatest(F.coalesce("_er", F.lit(0.0)), overlap))
            .otherwise(0.0)
        )
        named = F.coalesce("_plain", F.greatest(_c("_words"), F.coalesce("_vr", F.lit(0.0))))
        parts = parts.withColumns({"v": named, "e": described})
        raw = self.total(_c("a"), _c("d"), _c("v"), _c("e"))
        scored = parts.withColumn("raw_score", raw).withColumn("score", self.rank(_c("raw_score")))
        return scored.drop("_plain", "_words", "_most", "_hope", "_vr", "_er")

    def match_type(self) -> Column:
        raw = _c("raw_score")
        return (
            F.when(raw >= self.high, "high")
            .when(raw >= self.medium, "medium")
            .when(raw >= self.threshold, "low")
            .otherwise("no_match")
        )

    def reasons(self) -> Column:
        # Limits and wording of the reasons.
        return _listed(
            F.when(_c("a") > 0.8, _say("Amount match: $", _money("l_amount"), " ≈ $", _money("s_amount"))),
            F.when(_c("d") > 0.8, _say("Date match: ", _moment("l_date"), " ≈ ", _moment("s_date"))),
            F.when(_c("v") > 0.7, _say("Vendor match: '", _c("l_vendor"), "' ≈ '", _c("s_vendor"), "'")),
            F.when(
                _c("e") > 0.7,
                _say("Description similarity: '", _c("l_description"), "' ≈ '", _c("s_description"), "'"),
            ),
        )

    def discrepancies(self) -> Column:
        # Limits and wording of the discrepancies.
        return _listed(
            F.when(_c("a") < 0.5, _say("Amount difference: $", _money("l_amount"), " vs $", _money("s_amount"))),
            F.when(_c("d") < 0.5, _say("Date difference: ", _moment("l_date"), " vs ", _moment("s_date"))),
            F.when(_c("v") < 0.3, _say("Vendor difference: '", _c("l_vendor"), "' vs '", _c("s_vendor"), "'")),
        )


def tier(score: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def recommendation(tier_column: Column) -> Column:
    out = F.lit(RECOMMENDATIONS["low"])
    for name in ("medium", "high"):
        out = F.when(tier_column == name, RECOMMENDATIONS[name]).otherwise(out)
    return out


def profile(name: str | Deployed | Graded):
    if not isinstance(name, str):
        return name
    if name == "deployed":
        return Deployed()
    if name == "graded":
        return Graded()
    raise ValueError(f"unknown profile: {name}")


def _both_filled(x: Column, y: Column) -> Column:
    return F.coalesce((F.length(x) > 0) & (F.length(y) > 0), F.lit(False))


def _listed(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _say(*parts) -> Column:
    return F.concat(*(F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))


def _money(name: str) -> Column:
    """Amount as written in a reason: shortest text with at least one decimal."""
    digits = F.regexp_replace(F.col(name).try_cast("decimal(28,4)").cast("string"), "0+$", "")
    return F.regexp_replace(digits, r"\.$", ".0")


def _day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd")


def _moment(name: str) -> Column:
    """A day with its time, as the graded profile words it."""
    return F.coalesce(F.date_format(name, "yyyy-MM-dd HH:mm:ss"), F.lit("None"))
