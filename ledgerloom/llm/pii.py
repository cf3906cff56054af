"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

Generators, all regular expressions, propose spans of four kinds, high in recall and free to
overlap: the base patterns, and looser ones (addresses spelt out, dotted numbers with
brackets, bare or grouped runs of digits, national telephone numbers). A base match that
passes its check is a base span and always stays.

No labels of personal data are given, so a candidate teaches as positive if its own text is a base
match that passes the check, or if a base span of its kind holds it, else as negative. Its features
are its format and its context, never the check. One model of boosted trees per kind is fitted on the counts of equal
feature rows of all candidates and becomes a SQL expression. The threshold is the smallest score
from which on candidates of held-out texts are positive with a precision of ``PRECISION``. Candidates that reach it and meet no base span are added; overlapping ones of
a kind are joined.

Places are counted from the lengths of the texts between matches, summed per document and generator
by a window, so a text with many matches costs no more than their sort.

Defined results: a null text counts as empty and has no spans; rows with equal id and
text give the same spans each; a null id is an id like any other; without candidates, or without
a base span of a kind, nothing is added; an empty table gives an empty table. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.store import written

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
ROUNDS, DEPTH, RATE, SMOOTH = 24, 3, 0.3, 1.0
# Candidates a leaf must hold, so that single oddities make none.
LEAF = 20
CONTEXT = 24

# What a generator looks for, its kind, whether it is the base one, and characters
# without which no match can be. Possessive loops keep long texts linear; a start inside a run is
# tried only where the last match ended.
GENERATORS = (
    ("email", True, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", True, r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]"),
    ("card", True, r"[0-9](?:[ -]?+[0-9])++", "[0-9][0-9 -]{11}"),
    ("phone", True, r"\+[0-9][ ().0-9-]+[0-9]", "\\+[0-9]"),
    ("email", False, r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:@|[(\[{] ?at ?[)\]}]) ?[a-z0-9-]{1,63}+(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[a-z0-9-]{1,63}+){1,8}+", "(?i)@|[(\\[{] ?at ?[)\\]}]"),
    ("ip", False, r"(?<![0-9])[0-9]{1,3}+(?:(?: ?\. ?|[(\[]\.[)\]])[0-9]{1,3}+){3}(?![0-9])", "[0-9][ .(\\[]"),
    ("card", False, r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}+(?:[ .-][0-9]{4}+){3}|[0-9]{4}+[ .-][0-9]{6}+[ .-][0-9]{5}+)(?![0-9])", "[0-9][0-9 .-]{11}"),
    ("phone", False, r"(?<![0-9])(?:\+|00)[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", "(?:\\+|00)[0-9]"),
    ("phone", False, r"(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", "[0-9][ .-][0-9]"),
)
# Words that announce a kind.
CUES = {
    "email": "mail|contact|write|kontakt|contacto|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse|login",
    "card": "card|visa|credit|account|karte|konto|carte|tarjeta|pay",
    "phone": r"phone|\btel\b|call|mobil|fax|telefon|llam|appel",
}
# Parts of a dotted number of at most 255, with noughts before them.
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a sum of check digits that ends in nought."""

    def add(total: Column, k: Column) -> Column:
        # Every second digit from the right counts twice, less nine where that has two digits.
        digit = F.substr(digits, -k, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(k % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    """The check of a base match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    size = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(kind == "card", F.when(size.between(13, 19), _luhn(digits)).otherwise(False))
        .otherwise(size.between(9, 15))
    )


def sound(kind: Column, match: Column) -> Column:
    """Whether a text is itself a base match that passes its check."""
    whole = F.lit(False)
    for k, base, pattern, _ in GENERATORS:
        if base:
            whole = F.when(kind == k, match.rlike(f"^(?:{pattern})$")).otherwise(whole)
    return F.coalesce(whole & passes(kind, match), F.lit(False))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _digest, generator, at, before, match, after, gap): what the generators find.

    ``gap`` is the length of the text between this match and the one before it, whose end
    is ``before``; ``after`` is the beginning of what follows.
    """
    text = F.coalesce(text_col, F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    none = F.array().cast("array<string>")
    parts, found = {}, {}
    for g, (_, _, pattern, needs) in enumerate(GENERATORS):
        can = F.col("_text").rlike(needs)
        parts[f"_parts{g}"] = F.when(can, F.split("_text", pattern, -1)).otherwise(none)
        found[f"_found{g}"] = F.when(can, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none)
    apart = base.select("_id", F.md5("_text").alias("_digest"), *(c.alias(n) for n, c in {**parts, **found}.items()))

    def of(g: int) -> Column:
        following = F.slice(f"_parts{g}", F.lit(2), F.greatest(F.size(f"_parts{g}"), F.lit(1)))
        zipped = F.arrays_zip(F.col(f"_found{g}").alias("m"), F.slice(f"_parts{g}", F.lit(1), F.size(f"_found{g}")).alias("b"), following.alias("a"))
        return F.transform(
            zipped,
            lambda z, k: F.struct(
                F.lit(g).alias("generator"),
                k.alias("at"),
                F.right(z["b"], F.lit(CONTEXT)).alias("before"),
                z["m"].alias("match"),
                F.left(z["a"], F.lit(CONTEXT)).alias("after"),
                F.length(z["b"]).cast("long").alias("gap"),
            ),
        )

    each = F.concat(*(of(g) for g in range(len(GENERATORS))))
    return apart.select("_id", "_digest", F.explode(each).alias("_m")).select("_id", "_digest", "_m.*")


def _class(char: Column) -> Column:
    return (
        F.when(char == "", 0)
        .when(char.rlike(r"^\s"), 1)
        .when(char.rlike("^[0-9]"), 2)
        .when(char.rlike(r"^\p{L}"), 3)
        .when(char.rlike(r"^[.,;:!?()]"), 4)
        .otherwise(5)
    )


def _features(kind: Column) -> dict[str, Column]:
    """Format and context of a candidate, small whole numbers."""
    match, before, after = F.col("match"), F.col("before"), F.col("after")
    plain = F.regexp_replace(F.regexp_replace(match, r"(?i) ?[(\[{] ?at ?[)\]}] ?", "@"), r"(?i) ?(?:[(\[{] ?(?:dot|\.) ?[)\]}]) ?", ".")
    digits = F.regexp_replace(match, "[^0-9]", "")
    local = F.length(F.substring_index(plain, "@", 1))
    host = F.when(plain.contains("@"), F.substring_index(plain, "@", -1))
    cue = reduce(lambda c, k: c.when(kind == k, before.rlike(f"(?i)(?:{CUES[k]})")), KINDS[1:], F.when(kind == KINDS[0], before.rlike(f"(?i)(?:{CUES[KINDS[0]]})")))
    return {
        "digits": F.least(F.length(digits), F.lit(20)),
        "groups": F.least(F.size(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))), F.lit(8)),
        "first": F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(-1)),
        "dots": F.least(F.length(plain) - F.length(F.replace(plain, F.lit("."), F.lit(""))), F.lit(6)),
        "dashes": F.least(F.length(match) - F.length(F.translate(match, "-", "")), F.lit(6)),
        "blanks": F.least(F.length(match) - F.length(F.translate(match, " ", "")), F.lit(6)),
        "brackets": F.least(F.length(plain) - F.length(F.translate(plain, "()", "")), F.lit(4)),
        "local": F.when(host.isNull(), -1).otherwise(F.least(local, F.lit(20))),
        "top": F.when(host.isNull(), -1).otherwise(F.least(F.length(F.substring_index(host, ".", -1)), F.lit(10))),
        "behind": _class(F.right(before, F.lit(1))),
        "ahead": _class(F.left(after, F.lit(1))),
        "cue": F.coalesce(cue.cast("int"), F.lit(0)),
    }


FEATURES = (
    "digits", "groups", "first", "dots", "dashes", "blanks", "brackets", "local", "top", "behind", "ahead", "cue",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _digest, kind, base, loose, start, end, held, features): every span proposed, written once.

    ``base`` marks base spans, ``loose`` what other generators than the base ones propose; ``held`` those that are sound by themselves or inside a base span of their kind.
    """
    # Rows with equal id and text have the same matches; one of each is enough.
    own = matches(docs, id_col, text_col).dropDuplicates(["_id", "_digest", "generator", "at"])
    order = Window.partitionBy("_id", "_digest", "generator").orderBy("at")
    size = F.length("match").cast("long")
    end = F.sum(F.col("gap") + size).over(order)
    tables = [(F.lit(k), F.lit(b)) for k, b, _, _ in GENERATORS]
    kind, first = (F.element_at(F.array(*c), F.col("generator") + 1) for c in zip(*tables))
    placed = own.select("*", end.alias("end"), kind.alias("kind"), first.alias("_first")).withColumn("start", F.col("end") - size)
    placed = placed.withColumn("_sound", sound(F.col("kind"), F.col("match")))
    measured = placed.select(
        "_id",
        "_digest",
        "kind",
        (F.col("_first") & F.col("_sound")).alias("base"),
        (~F.col("_first")).alias("loose"),
        "_sound",
        "start",
        "end",
        *(c.cast("int").alias(n) for n, c in _features(F.col("kind")).items()),
    )
    inside = Window.partitionBy("_id", "_digest", "kind").orderBy("start", F.desc("end"))
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(inside)
    held = F.col("_sound") | F.coalesce(F.col("end") <= reach, F.lit(False))
    return written(measured.withColumn("held", held).drop("_sound"), "personal-candidates")


@dataclass(frozen=True)
class Model:
    """Per kind: trees as nested tuples (feature, bound, at most, above) or leaves, and the threshold of their sum."""

    trees: dict[str, tuple]
    least: dict[str, float]

    def score(self) -> Column:
        """The summed leaves for the kind of a candidate."""
        return _by_kind({k: _sum(t) for k, t in self.trees.items()}, F.lit(-99.0))

    def chosen(self) -> Column:
        return self.score() >= _by_kind({k: F.lit(v) for k, v in self.least.items()}, F.lit(99.0))


def _by_kind(values: dict[str, Column], otherwise: Column) -> Column:
    return reduce(lambda c, k: F.when(F.col("kind") == k, values[k]).otherwise(c), sorted(values), otherwise)


def _sum(trees: Iterable) -> Column:
    return reduce(lambda a, b: a + b, (_tree(t) for t in trees), F.lit(0.0))


def _tree(node) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, bound, below, above = node
    return F.when(F.col(FEATURES[feature]) <= bound, _tree(below)).otherwise(_tree(above))


def _grow(x: np.ndarray, n: np.ndarray, gradient: np.ndarray, curve: np.ndarray, depth: int):
    """A regression tree of Newton steps over rows that already hold sums."""
    g, h = float(gradient.sum()), float(curve.sum())
    best = (1e-6, None)
    if depth:
        for f in range(x.shape[1]):
            low = int(x[:, f].min())
            at = x[:, f] - low
            gs, hs = np.cumsum(np.bincount(at, gradient)), np.cumsum(np.bincount(at, curve))
            gain = gs**2 / (hs + SMOOTH) + (g - gs) ** 2 / (h - hs + SMOOTH) - g**2 / (h + SMOOTH)
            left = np.cumsum(np.bincount(at, n))
            gain[(left < LEAF) | (left[-1] - left < LEAF)] = 0.0
            if gain.max() > best[0]:
                best = (float(gain.max()), (f, low + int(gain.argmax())))
    if best[1] is None:
        return round(-RATE * g / (h + SMOOTH), 6)
    f, bound = best[1]
    left = x[:, f] <= bound
    return (
        f,
        bound,
        _grow(x[left], n[left], gradient[left], curve[left], depth - 1),
        _grow(x[~left], n[~left], gradient[~left], curve[~left], depth - 1),
    )


def _value(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    feature, bound, below, above = node
    return np.where(x[:, feature] <= bound, _value(below, x), _value(above, x))


def boost(x: np.ndarray, n: np.ndarray, positive: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> tuple:
    """Trees for the log odds of feature rows ``x`` seen ``n`` times, ``positive`` of them positive."""
    trees = []
    total = np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x, n, n * p - positive, n * p * (1 - p), depth)
        trees.append(tree)
        total += _value(tree, x)
    return tuple(trees)


def threshold(score: np.ndarray, n: np.ndarray, positive: np.ndarray, precision: float = PRECISION) -> float:
    """The smallest score from which on held-out candidates are positive often enough; out of reach if none.

    Between that score and the next lower one nothing is known, so there the odds the score stands
    for decide.
    """
    order = np.argsort(-score, kind="stable")
    score, n, positive = score[order], np.cumsum(n[order]), np.cumsum(positive[order])
    last = np.r_[score[1:] != score[:-1], True] if len(score) else np.zeros(0, bool)
    # One in two imagined candidates keeps a few chance finds from deciding.
    good = last & ((positive + 1) / (n + 2) >= precision)
    if not good.any():
        return 99.0
    least = float(score[good].min())
    lower = float(score[score < least].max(initial=-99.0))
    return min(least, max(lower + 1e-6, float(np.log(precision / (1 - precision))))) - 1e-9


def fit(spans: DataFrame) -> Model:
    """Learn from every candidate: the models from those of four fifths of the texts, the thresholds from the rest.

    Equal feature rows are counted on Spark; what comes to the driver are their counts, as Arrow columns.
    """
    fold = (F.pmod(F.xxhash64("_digest", F.lit("fold")), F.lit(5)) == 0).cast("int").alias("held_out")
    counts = (F.count(F.lit(1)).alias("n"), F.sum(F.col("held").cast("long")).alias("positive"))
    counted = spans.groupBy("kind", fold, *FEATURES).agg(*counts).toArrow()
    kinds = counted["kind"].to_numpy()
    numbers = [counted[c].to_numpy() for c in ("held_out", *FEATURES, "n", "positive")]
    trees, least = {}, {}
    for kind in KINDS:
        seen = np.column_stack([c[kinds == kind] for c in numbers])
        # In one order, whatever task a row came from.
        seen = seen[np.lexsort(seen.T[::-1])]
        out = seen[:, 0] == 1
        x, n, positive = seen[:, 1:-2], seen[:, -2].astype(float), seen[:, -1].astype(float)
        if not positive[~out].sum():
            continue
        trees[kind] = boost(x[~out], n[~out], positive[~out])
        score = sum((_value(t, x) for t in trees[kind]), np.zeros(len(x)))
        least[kind] = threshold(score[out], n[out], positive[out])
    return Model(trees, least)


def select(spans: DataFrame, model: Model) -> DataFrame:
    """(_id, _digest, kind, base, start, end): base spans, and joined added ones that meet no base span."""
    # A base match that fails its check is dropped as such; parts of it may be proposed by others.
    wanted = spans.filter(F.col("base") | F.col("loose") & model.chosen()).select("_id", "_digest", "kind", "base", "start", "end").distinct()
    here = Window.partitionBy("_id", "_digest").orderBy("start", "end", "kind", "base")
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    before = F.max(base_end).over(here.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(base_start).over(here.rowsBetween(1, Window.unboundedFollowing))
    meets = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(behind < F.col("end"), F.lit(False))
    stays = wanted.withColumn("_meets", meets).filter(F.col("base") | ~F.col("_meets")).drop("_meets")
    of_kind = Window.partitionBy("_id", "_digest", "kind", "base").orderBy("start", "end")
    reach = F.max("end").over(of_kind.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("base") | F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0)
    numbered = stays.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(of_kind))
    joined = numbered.groupBy("_id", "_digest", "kind", "base", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.drop("_island")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, spans): for every document its spans (rank of the kind, start, end, kind, base), base ones marked.

    Without a ``model`` one is fitted on the documents themselves.
    """
    found = candidates(docs, id_col, text_col)
    picked = select(found, model or fit(found))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int").alias("rank")
    # A document has no more spans than characters.
    each = picked.groupBy("_id", "_digest").agg(F.array_sort(F.collect_list(F.struct(rank, "start", "end", "kind", "base"))).alias("spans"))
    each = each.withColumnsRenamed({"_id": "_span_id", "_digest": "_span_digest"})
    own = docs.select(F.col(id_col).alias("_id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("_digest"))
    same = F.col("_id").eqNullSafe(F.col("_span_id")) & (F.col("_digest") == F.col("_span_digest"))
    none = F.array().cast(each.schema["spans"].dataType)
    return own.join(each, same, "left").select(F.col("_id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or stretch of overlapping spans, replaced by its first kind in brackets."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        gap = F.substr(text, (state["at"] + 1).cast("int"), (s["s"] - state["at"]).cast("int"))
        mark = F.concat(F.lit("["), F.upper(s["k"]), F.lit("]"))
        new = F.when(s["s"] >= state["at"], F.concat(state["out"], gap, mark)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["e"]).alias("at"), new.alias("out"))

    rest = lambda state: F.concat(state["out"], F.substr(text, (state["at"] + 1).cast("int"), F.greatest(F.length(text), F.lit(1))))
    return F.aggregate(order, start, add, rest)
