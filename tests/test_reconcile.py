import dataclasses
import datetime as dt
import json
import random

import oracle_matching as plain
import pytest
from pyspark.sql import functions as F

from ledgerloom.matching import candidates
from ledgerloom.matching.assign import empty_held, settle, settle_small
from ledgerloom.matching.scoring import Deployed, Graded
from ledgerloom.plans import reconcile as rec

SCHEMA = "session_id string, txn_id long, date date, vendor string, amount double, description string"
NAMES = ["session_id", "txn_id", "date", "vendor", "amount", "description"]
WORDS = ["Coffee", "Shop", "Shell", "Gas", "Office", "Joe's", "Amazon", "A", "Store", "The", "&", "Co"]


def day(text):
    return dt.date.fromisoformat(text)


LEDGER = [
    ("s", 0, day("2024-01-15"), "Coffee Shop Downtown", 4.50, "Morning coffee"),
    ("s", 1, day("2024-01-16"), "Shell Gas Station", 45.00, "Fuel"),
    ("s", 2, day("2024-01-17"), "Office Depot", 23.99, "Supplies"),
]
STATEMENT = [
    ("s", 0, day("2024-01-15"), "Coffee Shop", 4.50, "Coffee"),
    ("s", 1, day("2024-01-16"), "Shell", 45.00, "Gas"),
    ("s", 2, day("2024-01-18"), "Amazon", 12.99, "Online purchase"),
]


@pytest.mark.parametrize("profile, scores", [("deployed", [0.9, 0.85]), ("graded", [0.935, 0.875])])
def test_three_against_three(spark, profile, scores):
    led, stm = (spark.createDataFrame(rows, SCHEMA) for rows in (LEDGER, STATEMENT))
    result = rec.reconcile(led, stm, profile)
    rows = result.detailed().orderBy("statement_txn_id").collect()
    assert [(r.statement_txn_id, r.ledger_txn_id, r.tier) for r in rows] == [(0, 0, "high"), (1, 1, "high")]
    assert [r.confidence_score for r in rows] == scores
    assert rows[0].ledger_transaction.vendor == "Coffee Shop Downtown"
    assert rows[0].recommendation.startswith("Auto-approve")
    one = result.summary().first()
    assert (one.total_matches, one.match_rate, one.total_image_amount) == (2, 66.7, 62.49)
    assert (one.total_matched_amount, one.reconciliation_percentage) == (49.5, 79.2)
    assert sorted((r.source, r.txn_id) for r in result.unmatched().collect()) == [
        ("CSV (Unmatched)", 2), ("Image (Unmatched)", 2)
    ]
    assert rec.metric_rows(result.summary()).count() == 8
    shown = rec.display_matches(result.detailed()).orderBy("statement_txn_id").first()
    assert shown.confidence == f"{scores[0] * 100:.1f}%" and shown.csv_amount == "$4.50"
    sections = {r.section: r["count"] for r in result.documents().groupBy("section").count().collect()}
    assert sections == {
        "summary": 1, "matches.high_confidence": 2, "unmatched.image_transactions": 1, "unmatched.csv_transactions": 1
    }


def test_one_sided_session_is_all_zero(spark):
    led = spark.createDataFrame(LEDGER, SCHEMA)
    one = rec.reconcile(led, led.limit(0)).summary().first()
    assert (one.total_csv_transactions, one.total_matches, one.match_rate) == (3, 0, 0.0)


def _edges(spark, edges):
    return spark.createDataFrame([("s", *e) for e in edges], "session_id string, stmt long, led long, score double")


def test_contention(spark):
    edges = [(0, 0, 0.9), (0, 1, 0.9), (1, 0, 0.9), (1, 2, 0.4), (2, 2, 0.8), (3, 2, 0.9)]
    df = _edges(spark, edges)
    for held in (settle(df, empty_held(df)), settle_small(df)):
        assert sorted((r.stmt, r.led) for r in held.collect()) == [(0, 0), (1, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_serial_order(spark, seed):
    rnd = random.Random(seed)
    edges = [(s, led, rnd.choice([0.4, 0.5, 0.9])) for s in range(14) for led in range(12) if rnd.random() < 0.4]
    df = _edges(spark, edges).cache()
    want = plain.serial_edges(edges)
    for length in (2, 64):
        got = settle(df, empty_held(df), length)
        assert {r.stmt: r.led for r in got.collect()} == want
    assert {r.stmt: r.led for r in settle_small(df).collect()} == want


def test_equal_rows_settle_in_one_turn(spark):
    edges = [(s, led, 0.5) for s in range(30) for led in range(30)]
    df = _edges(spark, edges)
    assert {r.stmt: r.led for r in settle(df, empty_held(df)).collect()} == {i: i for i in range(30)}


def _record(rnd, session, key):
    vendor = rnd.choice([None, "", " ".join(rnd.choices(WORDS, k=rnd.randint(1, 3))), "Amazon", "Amazon Store"])
    date = rnd.choice([None] + [dt.date(2024, 1, rnd.randint(1, 25))] * 8)
    amount = rnd.choice(
        [None, 0.0, 0.01, 0.02, 9.99, 9.99, round(rnd.uniform(90, 110), 2), -round(rnd.uniform(90, 110), 2), round(rnd.uniform(0, 1), 2)]
    )
    return (session, key, date, vendor, amount, rnd.choice([None, "", "Fuel", "Morning coffee", "Coffee", "Supplies and co"]))


def _case(spark, seed, sessions, n_led, n_stm, extra=()):
    rnd = random.Random(seed)
    led = [_record(rnd, str(s), i) for s in range(sessions) for i in range(n_led)]
    stm = [_record(rnd, str(s), i) for s in range(sessions) for i in range(n_stm)]
    for side, rows in zip((led, stm), extra):
        side += rows
    return led, stm, spark.createDataFrame(led, SCHEMA), spark.createDataFrame(stm, SCHEMA)


def _serial(led, stm, profile):
    out = {}
    for s in {r[0] for r in led}:
        mine = [[dict(zip(NAMES, r)) for r in side if r[0] == s] for side in (led, stm)]
        out |= {(s, k): v for k, v in plain.serial(*mine, profile).items()}
    return out


def _matched(result):
    return {(r.session_id, r.statement_txn_id): r.ledger_txn_id for r in result.matches.collect()}


@pytest.mark.parametrize("profile", ["deployed", "graded"])
def test_small_sessions_equal_serial_order(spark, profile):
    led, stm, ldf, sdf = _case(spark, 5, 3, 40, 30)
    assert _matched(rec.reconcile(ldf, sdf, profile)) == _serial(led, stm, profile)


@pytest.mark.parametrize("profile, shown", [("deployed", 64), ("deployed", 3), ("graded", 4)])
def test_blocked_sessions_equal_serial_order(spark, profile, shown):
    copies = [("0", 100 + i, dt.date(2024, 1, 5), "Spotify", 9.99, "music") for i in range(12)]
    hot = [("0", 200 + i, dt.date(2024, 2, 1) + dt.timedelta(days=20 * i), "Netflix", 500.0 + 37 * i, "video") for i in range(8)]
    other = [("0", 200 + i, dt.date(2024, 2, 3) + dt.timedelta(days=17 * i), "Netflix", 9000.0 + 41 * i, "tv") for i in range(6)]
    led, stm, ldf, sdf = _case(spark, 7, 1, 16, 10, (copies + hot, copies[:8] + other))
    result = rec.reconcile(ldf, sdf, profile, small_session_pairs=0, rows_shown=shown)
    assert _matched(result) == _serial(led, stm, profile)


@pytest.mark.parametrize("small", [0, 10**6])
def test_best_matches(spark, small):
    led, stm, ldf, sdf = _case(spark, 9, 1, 25, 12)
    got = {r.stmt: (r.led, r.score) for r in rec.best_matches(ldf, sdf, small_session_pairs=small, rows_shown=4).collect()}
    want = {}
    for s in stm:
        best = max((plain.deployed(dict(zip(NAMES, x)), dict(zip(NAMES, s))), -x[1]) for x in led)
        if best[0] > 0.3:
            want[s[1]] = (-best[1], best[0])
    assert got == want


def test_blocks_find_every_accepted_pair(spark):
    led, stm, ldf, sdf = _case(spark, 11, 1, 60, 40)
    for rules, score in ((Deployed(), plain.deployed), (Graded(), plain.graded)):
        left, right = rec.prepared(ldf, sdf, rules)
        plan = candidates.dictionaries(candidates.plan_for(rules), right, left)
        edges = candidates.phase_edges(plan, len(plan.phases) - 1, right, left.withColumn("held", F.lit(False)), 10**6)
        got = {(r.stmt, r.led) for r in edges.collect()}
        want = set()
        for s in stm:
            for x in led:
                value = score(dict(zip(NAMES, x)), dict(zip(NAMES, s)))
                if value > 0.3 if score is plain.deployed else round(value + 1e-12, 3) >= 0.3:
                    want.add((s[1], x[1]))
        assert got == want


def test_no_cartesian_product(spark):
    _, _, ldf, sdf = _case(spark, 13, 1, 20, 20)
    rules = Deployed()
    left, right = rec.prepared(ldf, sdf, rules)
    plan = candidates.dictionaries(candidates.plan_for(rules), right, left)
    edges = candidates.phase_edges(plan, 1, right, left.withColumn("held", F.lit(False)), 64)
    physical = edges._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "NestedLoopJoin" not in physical


def test_amount_levels(spark):
    amounts = [100.0, 100.01, 101.0, 105.0, 109.0, 120.0]
    df = spark.createDataFrame([(100.0, a) for a in amounts], "l_amount double, s_amount double")
    got = [r[0] for r in df.select(Graded().amount_score()).collect()]
    assert got == [1.0, 0.9, 0.9, 0.7, 0.5, 0.0]
    days = spark.createDataFrame([(day("2024-01-10"), dt.date(2024, 1, 10 + d)) for d in (0, 1, 2, 3, 4, 6, 7)], "l_date date, s_date date")
    assert [round(r[0], 6) for r in days.select(Graded().date_score()).collect()] == [1.0, 0.9, 0.8, 0.7, 0.5, 0.5, 0.0]


@pytest.mark.parametrize("rules", [Deployed(threshold=0.2), Graded(threshold=0.2)])
def test_low_thresholds_match_alike_at_every_size(spark, rules):
    _, _, ldf, sdf = _case(spark, 15, 1, 20, 14)
    small = rec.reconcile(ldf, sdf, rules, small_session_pairs=10**6)
    large = rec.reconcile(ldf, sdf, rules, small_session_pairs=0, rows_shown=4)
    assert _matched(small) == _matched(large) != {}


def test_large_groups_of_equal_rows_take_few_rounds(spark, monkeypatch):
    from ledgerloom.matching import assign

    rounds = []
    kept = assign._round
    monkeypatch.setattr(assign, "_round", lambda *a: rounds.append(1) or kept(*a))
    edges = spark.range(200).crossJoin(spark.range(200).withColumnRenamed("id", "led"))
    df = edges.selectExpr("'s' AS session_id", "id AS stmt", "led", "0.5D AS score")
    held = assign.settle(df, empty_held(df), 4)
    assert held.where("stmt = led").count() == 200 and len(rounds) <= 8


def test_unknown_profile_is_refused():
    with pytest.raises(ValueError):
        rec.scoring.profile("other")


def test_graded_reasons_word_days_with_time(spark):
    led = spark.createDataFrame([("s", 1, day("2024-01-15"), "Shell", 45.0, "Fuel"), ("s", 2, None, "Depot", 7.0, "Ink")], SCHEMA)
    stm = spark.createDataFrame([("s", 1, day("2024-01-15"), "Shell", 45.0, "Gas"), ("s", 2, day("2024-01-18"), "Depot", 7.0, "Ink")], SCHEMA)
    rows = {r.statement_txn_id: r for r in rec.reconcile(led, stm, "graded").matches.collect()}
    assert "Date match: 2024-01-15 00:00:00 ≈ 2024-01-15 00:00:00" in rows[1].match_reasons
    assert "Date difference: None vs 2024-01-18 00:00:00" in rows[2].discrepancies


@pytest.mark.parametrize("per_part", [1, 2, 1000])
def test_parts_concatenate_to_one_document(spark, per_part):
    *_, led, stm = _case(spark, 5, 3, 12, 9)
    only = spark.createDataFrame([("alone", 1, day("2024-01-01"), "Shell \"x\"", 2.0, None)], SCHEMA)
    result = rec.reconcile(led.unionByName(only), stm)
    parts = sorted(map(tuple, result.nested_documents(per_part).select("session_id", "list", "part", "body").collect()))
    assert len({p[:3] for p in parts}) == len(parts)
    summary = {r.session_id: r for r in result.summary().collect()}
    matches = result.matches.collect()
    assert set(summary) == {p[0] for p in parts} and "alone" in summary
    for sid, one in summary.items():
        doc = json.loads("".join(p[3] for p in parts if p[0] == sid))
        assert doc["summary"] == {k: v for k, v in one.asDict().items() if k != "session_id"}
        for tier in ("high", "medium", "low"):
            found = [m["statement_txn_id"] for m in doc["matches"][f"{tier}_confidence"]]
            assert found == sorted(m.statement_txn_id for m in matches if m.session_id == sid and m.tier == tier)
        assert len(doc["unmatched"]["image_transactions"]) == one.unmatched_image_transactions
        assert len(doc["unmatched"]["csv_transactions"]) == one.unmatched_csv_transactions
    assert max(p[3].count('"txn_id"') for p in parts) <= 2 * per_part


@pytest.mark.parametrize("made", ["documents", "nested_documents"])
def test_documents_work_out_the_matches_once(spark, made):
    rows = [("a", k, f"2024-01-{k:02d}", f"Shop {k}", 10.0 * k, "goods") for k in range(1, 8)]
    schema = "session_id string, txn_id long, date string, vendor string, amount double, description string"
    ledger = spark.createDataFrame(rows, schema).withColumn("date", F.to_date("date"))
    result = rec.reconcile(ledger, ledger.where("txn_id > 2").unionByName(ledger.where("txn_id = 1").withColumn("amount", F.lit(None).cast("double"))))
    want = sorted(map(tuple, getattr(result, made)().collect()))
    given = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            given.add(batch.num_rows)
            yield batch

    matches = result.matches.mapInArrow(counted, result.matches.schema)
    there = result.matches.count()
    assert sorted(map(tuple, getattr(dataclasses.replace(result, matches=matches), made)().collect())) == want
    assert given.value == there > 4
