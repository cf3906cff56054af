"""Reconciliation of ledgers with statements, for all sessions in one run."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values
from ledgerloom.lineage import checkpoint, written
from ledgerloom.matching import candidates as cand
from ledgerloom.matching import scoring
from ledgerloom.matching.assign import empty_held, settle, settle_small
from ledgerloom.matching.whole import can_settle, matched_rows
from ledgerloom.operators.ranking import spread_row_number

SID = "session_id"
# A session with more pairs than this is blocked instead of paired row by row.
SMALL_SESSION_PAIRS = 16_384
# Up to so many times as many pairs, and so many rows, a session is settled row by row in one task.
WHOLE_SESSION_SHARE = 2**24
WHOLE_SESSION_ROWS = 2**20
# Rows of one look-alike group shown to a phase before a statement row must ask again.
ROWS_SHOWN = 64

# Labels of the rows without a partner.
UNMATCHED_STATEMENT = "Image (Unmatched)"
UNMATCHED_LEDGER = "CSV (Unmatched)"


@dataclass
class Reconciliation:
    """Matches and the two inputs they came from; everything else follows from these."""

    ledger: DataFrame
    statement: DataFrame
    matches: DataFrame
    profile: scoring.Deployed | scoring.Graded

    @property
    def unmatched_ledger(self) -> DataFrame:
        taken = self.matches.select(SID, F.col("ledger_txn_id").alias("txn_id"))
        return self.ledger.join(taken, [SID, "txn_id"], "left_anti")

    @property
    def unmatched_statement(self) -> DataFrame:
        taken = self.matches.select(SID, F.col("statement_txn_id").alias("txn_id"))
        return self.statement.join(taken, [SID, "txn_id"], "left_anti")

    def unmatched(self) -> DataFrame:
        """Both sides' rows without a partner, labelled by source."""

        def side(df: DataFrame, label: str) -> DataFrame:
            return df.select(
                SID, "txn_id", F.lit(label).alias("source"), "date", "vendor", "amount", _optional(df, "description")
            )

        return side(self.unmatched_statement, UNMATCHED_STATEMENT).unionByName(
            side(self.unmatched_ledger, UNMATCHED_LEDGER)
        )

    def summary(self) -> DataFrame:
        return summary(self.ledger, self.statement, self.matches)

    def detailed(self) -> DataFrame:
        """Matches with both full records, reasons and discrepancies."""
        return attach(self.matches, self.ledger, self.statement)

    def documents(self) -> DataFrame:
        return result_documents(self)

    def nested_documents(self, records_per_part: int | None = None) -> DataFrame:
        return nested_documents(self, records_per_part or RECORDS_PER_PART)


def reconcile(
    ledger: DataFrame,
    statement: DataFrame,
    profile: str | scoring.Deployed | scoring.Graded = "deployed",
    amount_sign: str = "as_is",
    small_session_pairs: int = SMALL_SESSION_PAIRS,
    rows_shown: int = ROWS_SHOWN,
) -> Reconciliation:
    """Match every statement row, in id order, with its best ledger row still free.

    Both inputs need session_id, txn_id (unique per session), date, vendor and
    amount; description is optional.
    """
    rules = scoring.profile(profile)
    led, stm = prepared(ledger, statement, rules, amount_sign)
    return Reconciliation(ledger, statement, matched(led, stm, rules, small_session_pairs, rows_shown), rules)


def prepared(ledger: DataFrame, statement: DataFrame, rules, amount_sign: str = "as_is"):
    if amount_sign not in ("as_is", "absolute"):
        raise ValueError(f"unknown amount_sign: {amount_sign}")

    def side(df: DataFrame, source: str, letter: str, key: str) -> DataFrame:
        if amount_sign == "absolute":
            df = df.withColumn("amount", F.abs("amount"))
        names = {c: f"{letter}_{c}" for c in scoring.SIDE_COLUMNS + scoring.ROW_COLUMNS} | {"txn_id": key}
        ready = rules.prepare(df, source).withColumn("txn_id", F.col("txn_id").cast("long"))
        return ready.withColumnsRenamed(names)

    return side(ledger, "csv", "l", "led"), side(statement, "image", "s", "stmt")


def matched(led: DataFrame, stm: DataFrame, rules, small_pairs: int, rows_shown: int) -> DataFrame:
    """Scored matches of all sessions, each settled in the way its size asks for."""
    sizes = checkpoint(session_sizes(led, stm))
    one_sided, large = F.col("pairs") == 0, F.col("pairs") > small_pairs
    fits = (F.col("pairs") <= small_pairs * WHOLE_SESSION_SHARE) & (F.col("rows") <= WHOLE_SESSION_ROWS)
    whole = large & fits & F.lit(can_settle(led, stm, rules))
    n = sizes.agg(
        F.count_if(one_sided).alias("one_sided"), F.count_if(large).alias("large"),
        F.count_if(~one_sided & ~large).alias("small"), F.count_if(whole).alias("whole"),
    ).first()

    def only(which: Column, how: str = "left_semi") -> tuple[DataFrame, DataFrame]:
        sessions = sizes.where(which).select(SID)
        return led.join(sessions, SID, how), stm.join(sessions, SID, how)

    parts, held = [], []
    if n.whole:
        # Both rows of a pair leave the task that found it, so neither side is read or joined again.
        alone = n.whole == n.large and not n.one_sided + n.small
        rows = written(matched_rows(*((led, stm) if alone else only(whole)), rules), "matched")
        parts.append(_scored(rules.with_words(rules.with_words(rows, "l_"), "s_"), rules))
    if n.small or not n.large:
        held.append(_assign_small(*(only(large, "left_anti") if n.large else (led, stm)), rules))
    if n.large > n.whole:
        held.append(_assign_large(*map(checkpoint, only(large & ~whole)), rules, rows_shown))
    if held:
        parts.append(scored_matches(reduce(DataFrame.unionByName, held), led, stm, rules))
    return reduce(DataFrame.unionByName, parts)


def session_sizes(led: DataFrame, stm: DataFrame) -> DataFrame:
    """Rows of both sides and row pairs of every session."""
    sides = (df.where(F.col(SID).isNotNull()).select(SID, F.lit(k).alias("of_ledger")) for df, k in ((led, 1), (stm, 0)))
    counted = reduce(DataFrame.unionByName, sides).groupBy(SID).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("of_ledger").alias("nl")
    )
    return counted.select(SID, "rows", (F.col("nl") * (F.col("rows") - F.col("nl"))).alias("pairs"))


def large_sessions(led: DataFrame, stm: DataFrame, small_pairs: int) -> DataFrame:
    """Sessions with more row pairs than may be compared one by one."""
    return checkpoint(session_sizes(led, stm).where(F.col("pairs") > small_pairs).select(SID, "pairs"))


def _with_dictionaries(rules, led: DataFrame, stm: DataFrame) -> cand.Plan:
    plan = cand.dictionaries(cand.plan_for(rules), stm, led)
    if plan.vendors is not None:
        plan.vendors = checkpoint(plan.vendors)
    if plan.descriptions is not None:
        plan.descriptions = checkpoint(plan.descriptions)
    return plan


def _assign_small(led: DataFrame, stm: DataFrame, rules) -> DataFrame:
    # Three numbers per match, kept because every part of the result reads them.
    return checkpoint(settle_small(cand.pair_sessions(stm, led, rules)))


def _assign_large(led: DataFrame, stm: DataFrame, rules, rows_shown: int) -> DataFrame:
    """Phase by phase, each repeated until nobody without a partner has candidates left."""
    plan = _with_dictionaries(rules, led, stm)
    everyone = stm.select(SID, "stmt")
    held = empty_held(
        everyone.select(SID, "stmt", F.lit(0).cast("long").alias("led"), F.lit(0.0).alias("score"))
    )
    for number in range(len(plan.phases)):
        # Rows whose candidates are all known, and every edge found in this phase.
        complete, edges, shown, turn = everyone.where(F.lit(False)), None, rows_shown, 0
        while True:
            free = everyone.join(held.select(SID, "stmt"), [SID, "stmt"], "left_anti")
            active = checkpoint(free.join(complete, [SID, "stmt"], "left_anti"))
            if active.isEmpty():
                break
            asking = active
            if turn == 1:
                # Some rows lost a partner from an earlier phase. Look up all rows of their
                # sessions now, so that a chain of such losses needs no further look-ups.
                unsettled = everyone.join(active.select(SID).distinct(), SID, "left_semi")
                asking = checkpoint(unsettled.join(complete, [SID, "stmt"], "left_anti"))
            found = checkpoint(
                cand.phase_edges(
                    plan, number, stm.join(asking, [SID, "stmt"]), _takeable(led, held, asking), shown
                )
            )
            usable = found.where(F.col("led").isNotNull()).select(SID, "stmt", "led", "score")
            edges = usable if edges is None else edges.unionByName(usable)
            held = settle(edges, held)
            cut_off = found.where("cut_off").select(SID, "stmt").distinct()
            complete = checkpoint(
                complete.unionByName(asking.join(cut_off, [SID, "stmt"], "left_anti"))
            )
            shown, turn = shown * 4, turn + 1
    return held.drop("fresh")


def _takeable(led: DataFrame, held: DataFrame, active: DataFrame) -> DataFrame:
    """Ledger rows that are free or held by a later row than the first one still asking."""
    first = active.groupBy(SID).agg(F.min("stmt").alias("first"))
    holders = held.select(SID, "led", F.col("stmt").alias("holder"))
    rows = led.join(first, SID).join(holders, [SID, "led"], "left")
    open_rows = rows.where(F.col("holder").isNull() | (F.col("holder") > F.col("first")))
    return open_rows.withColumn("held", F.col("holder").isNotNull()).drop("first", "holder")


def scored_matches(held: DataFrame, led: DataFrame, stm: DataFrame, rules) -> DataFrame:
    """Component scores, labels and texts of the assigned pairs."""
    return _scored(held.select(SID, "led", "stmt").join(led, [SID, "led"]).join(stm, [SID, "stmt"]), rules)


def _scored(pairs: DataFrame, rules) -> DataFrame:
    scored = rules.add_scores(pairs)
    confidence = F.round("score", 3)
    return (
        scored.withColumn("confidence_score", confidence)
        .withColumn("tier", scoring.tier(F.col("confidence_score"), rules.high, rules.medium))
        .select(
            SID,
            F.col("led").alias("ledger_txn_id"),
            F.col("stmt").alias("statement_txn_id"),
            F.col("a").alias("amount_score"),
            F.col("d").alias("date_score"),
            F.col("v").alias("vendor_score"),
            F.col("e").alias("description_score"),
            "confidence_score",
            rules.match_type().alias("match_type"),
            "tier",
            rules.reasons().alias("match_reasons"),
            rules.discrepancies().alias("discrepancies"),
            scoring.recommendation(F.col("tier")).alias("recommendation"),
        )
    )


def best_matches(
    ledger: DataFrame,
    statement: DataFrame,
    profile="deployed",
    small_session_pairs: int = SMALL_SESSION_PAIRS,
    rows_shown: int = ROWS_SHOWN,
) -> DataFrame:
    """Best ledger row of every statement row, although several may share it."""
    rules = scoring.profile(profile)
    led, stm = prepared(ledger, statement, rules)
    large = large_sessions(led, stm, small_session_pairs)
    if large.isEmpty():
        return _best(cand.pair_sessions(stm, led, rules))
    found = _best(
        cand.pair_sessions(stm.join(large, SID, "left_anti"), led.join(large, SID, "left_anti"), rules)
    )
    led, stm = (checkpoint(df.join(large, SID, "left_semi")) for df in (led, stm))
    plan = _with_dictionaries(rules, led, stm)
    rows = led.withColumn("held", F.lit(False))
    asking = stm
    for number in range(len(plan.phases)):
        shown, later = rows_shown, asking.where(F.lit(False))
        while not asking.isEmpty():
            edges = checkpoint(cand.phase_edges(plan, number, asking, rows, shown))
            best = _best(edges.where(F.col("led").isNotNull()))
            found = found.unionByName(best)
            # Only a row that was cut off before its first candidate has to look again.
            again = edges.where("cut_off").join(best, [SID, "stmt"], "left_anti")
            left_over = asking.join(best, [SID, "stmt"], "left_anti")
            retry = checkpoint(left_over.join(again.select(SID, "stmt"), [SID, "stmt"], "left_semi"))
            rest = left_over.join(again.select(SID, "stmt"), [SID, "stmt"], "left_anti")
            asking, shown, later = retry, shown * 4, later.unionByName(rest)
        asking = checkpoint(later)
    return found


def _best(edges: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("led", "score"), F.struct((-F.col("score")).alias("s"), "led"))
    return edges.groupBy(SID, "stmt").agg(best.alias("b")).select(
        SID, "stmt", F.col("b.led").alias("led"), F.col("b.score").alias("score")
    )


def attach(matches: DataFrame, ledger: DataFrame, statement: DataFrame) -> DataFrame:
    """Add both full records to each match as structs."""

    def record(df: DataFrame, key: str, out: str) -> DataFrame:
        return df.select(SID, F.col("txn_id").alias(key), F.struct(*df.columns).alias(out))

    return matches.join(record(ledger, "ledger_txn_id", "ledger_transaction"), [SID, "ledger_txn_id"]).join(
        record(statement, "statement_txn_id", "statement_transaction"), [SID, "statement_txn_id"]
    )


def summary(ledger: DataFrame, statement: DataFrame, matches: DataFrame) -> DataFrame:
    """Twelve measures per session; a session with one side only has zeros, not an error."""
    led = ledger.groupBy(SID).agg(F.count(F.lit(1)).alias("csv"))
    stm = statement.groupBy(SID).agg(
        F.count(F.lit(1)).alias("img"), values.total(F.col("amount")).alias("img_amount")
    )
    amounts = statement.select(SID, F.col("txn_id").alias("statement_txn_id"), "amount")
    met = (
        matches.select(SID, "statement_txn_id", "tier")
        .join(amounts, [SID, "statement_txn_id"])
        .groupBy(SID)
        .agg(
            F.count(F.lit(1)).alias("hits"),
            *(F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium", "low")),
            values.total(F.col("amount")).alias("hit_amount"),
        )
    )
    c = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("csv", "img", "hits", "high", "medium", "low")}
    total, matched = (F.coalesce(F.col(n), F.lit(0).cast("decimal(38,4)")) for n in ("img_amount", "hit_amount"))
    rate = c["hits"] * 100.0 / F.nullif(c["img"], F.lit(0))
    share = matched.cast("double") * 100.0 / F.nullif(total.cast("double"), F.lit(0.0))
    return led.join(stm, SID, "full").join(met, SID, "left").select(
        SID,
        c["img"].alias("total_image_transactions"),
        c["csv"].alias("total_csv_transactions"),
        c["hits"].alias("total_matches"),
        F.coalesce(values.half_up(rate, 1), F.lit(0.0)).alias("match_rate"),
        c["high"].alias("high_confidence_matches"),
        c["medium"].alias("medium_confidence_matches"),
        c["low"].alias("low_confidence_matches"),
        (c["img"] - c["hits"]).alias("unmatched_image_transactions"),
        (c["csv"] - c["hits"]).alias("unmatched_csv_transactions"),
        values.rounded(total, 2).alias("total_image_amount"),
        values.rounded(matched, 2).alias("total_matched_amount"),
        F.coalesce(values.half_up(share, 1), F.lit(0.0)).alias("reconciliation_percentage"),
    )


def sessions_with_both_sides(ledger: DataFrame, statement: DataFrame) -> DataFrame:
    """Sessions that can be reconciled at all."""
    return ledger.select(SID).distinct().join(statement.select(SID).distinct(), SID)


def metric_rows(summaries: DataFrame) -> DataFrame:
    """The eight headline measures of each session as metric and value."""
    text = lambda n: F.col(n).cast("string")
    percent = lambda n: F.concat(text(n), F.lit("%"))
    # Names and order of the measures.
    metrics = [
        ("CSV Transactions", text("total_csv_transactions")),
        ("Image Transactions", text("total_image_transactions")),
        ("Total Matches", F.concat(text("total_matches"), F.lit(" ("), text("match_rate"), F.lit("%)"))),
        ("High Confidence Matches", text("high_confidence_matches")),
        ("Medium Confidence Matches", text("medium_confidence_matches")),
        ("Low Confidence Matches", text("low_confidence_matches")),
        ("Match Rate", percent("match_rate")),
        ("Reconciliation %", percent("reconciliation_percentage")),
    ]
    rows = F.array(
        *(
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("metric"), value.alias("value"))
            for i, (name, value) in enumerate(metrics)
        )
    )
    return summaries.select(SID, F.inline(rows))


def display_matches(detailed: DataFrame) -> DataFrame:
    """Matches as shown to a person: percent, money and joined texts."""
    dollars = lambda c: F.concat(F.lit("$"), values.plain_money_text(F.coalesce(c, F.lit(0.0))))
    led, stm = "ledger_transaction", "statement_transaction"
    return detailed.select(
        SID,
        "statement_txn_id",
        "tier",
        F.format_string("%.1f%%", F.col("confidence_score") * 100).alias("confidence"),
        values.day_text(F.col(f"{led}.date")).alias("csv_date"),
        F.col(f"{led}.vendor").alias("csv_vendor"),
        dollars(F.col(f"{led}.amount")).alias("csv_amount"),
        values.day_text(F.col(f"{stm}.date")).alias("image_date"),
        F.col(f"{stm}.vendor").alias("image_vendor"),
        dollars(F.col(f"{stm}.amount")).alias("image_amount"),
        F.array_join("match_reasons", ", ").alias("match_reasons"),
        F.array_join("discrepancies", ", ").alias("discrepancies"),
    )


def display_unmatched(rows: DataFrame) -> DataFrame:
    return rows.select(
        SID,
        "txn_id",
        "source",
        values.day_text(F.col("date")).alias("date"),
        "vendor",
        F.concat(F.lit("$"), values.plain_money_text(F.coalesce("amount", F.lit(0.0)))).alias("amount"),
        "description",
    )


def result_documents(result: Reconciliation) -> DataFrame:
    """The whole result as JSON records: one per summary, match and unmatched row.

    The parts stay separate records under one schema, so a session with most
    of the rows never has to fit into a single document.
    """

    def part(df: DataFrame, name: Column) -> DataFrame:
        body = F.to_json(F.struct(*[c for c in df.columns if c != SID]))
        return df.select(SID, name.alias("section"), body.alias("body"))

    # All four sections read the matches, most of them a few columns.
    result = replace(result, matches=written(result.matches, "matches"))
    detailed = result.detailed()
    sections = [
        part(result.summary(), F.lit("summary")),
        part(detailed, F.concat(F.lit("matches."), F.col("tier"), F.lit("_confidence"))),
        part(result.unmatched_statement, F.lit("unmatched.image_transactions")),
        part(result.unmatched_ledger, F.lit("unmatched.csv_transactions")),
    ]
    out = sections[0]
    for section in sections[1:]:
        out = out.unionByName(section)
    return out


# Records in one part of a nested document.
RECORDS_PER_PART = 1000
_SLOTS = 64
# The lists of a nested document, in order, and what stands before each.
LISTS = [
    ("matches.high_confidence", ',"matches":{"high_confidence":['),
    ("matches.medium_confidence", '],"medium_confidence":['),
    ("matches.low_confidence", '],"low_confidence":['),
    ("unmatched.image_transactions", ']},"unmatched":{"image_transactions":['),
    ("unmatched.csv_transactions", '],"csv_transactions":['),
]


def nested_documents(result: Reconciliation, records_per_part: int = RECORDS_PER_PART) -> DataFrame:
    """One JSON document per session, in parts that concatenate: session_id, list, part, body.

    The bodies of a session, joined in the order of ``list`` and ``part``, are the document:
    status, summary, matches by tier, and rows without a partner. A part holds at most
    ``records_per_part`` records, so no task ever holds a large session's document. The
    summary is list 0 and the end of the document the last list; an empty list has one
    part without records. Lists are in the order of the statement's ids, or the ledger's for its own rows.
    """
    result = replace(result, matches=written(result.matches, "matches"))
    matches = result.detailed()
    records = _listed(matches, F.concat(F.lit("matches."), F.col("tier"), F.lit("_confidence")), "statement_txn_id")
    for rows, name in ((result.unmatched_statement, LISTS[3][0]), (result.unmatched_ledger, LISTS[4][0])):
        records = records.unionByName(_listed(rows, F.lit(name), "txn_id"))
    records = checkpoint(records)
    # Slots hold about equally many records of all sessions, however the ids are spread.
    marks = records.agg(F.percentile_approx("key", [k / _SLOTS for k in range(1, _SLOTS)])).scalar()
    slot = F.size(F.filter(F.coalesce("_marks", F.expr("array()")), lambda m: m < F.col("key")))
    ranked = spread_row_number(records.withColumn("_marks", marks), [SID, "name"], F.struct("key", "body"), slot, "rank")
    parts = (
        ranked.select(SID, "name", F.floor((F.col("rank") - 1) / records_per_part).alias("part"), F.struct("rank", "body").alias("r"))
        .groupBy(SID, "name", "part")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["body"]), ",").alias("lines"))
    )
    summaries = checkpoint(result.summary())
    lists = F.array(
        *(F.struct(F.lit(k).alias("list"), F.lit(n).alias("name"), F.lit(o).alias("opening")) for k, (n, o) in enumerate(LISTS, 1))
    )
    # A part knows its list's opening, so only empty lists are looked up, by names alone.
    listed = summaries.select(SID, F.inline(lists))
    empty = listed.join(records.select(SID, "name").distinct(), [SID, "name"], "left_anti")
    which = lambda c: F.filter(lists, lambda x: x["name"] == F.col("name"))[0][c]
    body = F.concat(F.when(F.col("part") == 0, which("opening")).otherwise(","), F.coalesce("lines", F.lit("")))
    filled = parts.where(F.col(SID).isNotNull()).select(SID, which("list").alias("list"), "part", body.alias("body"))
    nested = filled.unionByName(empty.select(SID, "list", F.lit(0).cast("long").alias("part"), F.col("opening").alias("body")))
    edge = lambda k, text: summaries.select(SID, F.lit(k).alias("list"), F.lit(0).cast("long").alias("part"), text.alias("body"))
    return (
        edge(0, F.concat(F.lit('{"status":"success","summary":'), _json(summaries)))
        .unionByName(nested)
        .unionByName(edge(len(LISTS) + 1, F.lit("]}}")))
    )


def _json(df: DataFrame) -> Column:
    """A row without its session as JSON, nulls written out."""
    return F.to_json(F.struct(*[c for c in df.columns if c != SID]), {"ignoreNullFields": "false"})


def _listed(df: DataFrame, name: Column, key: str) -> DataFrame:
    return df.select(SID, name.alias("name"), F.col(key).cast("long").alias("key"), _json(df).alias("body"))


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name)
