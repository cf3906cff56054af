import datetime as dt
import random

import oracle_matching as plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.matching import whole
from ledgerloom.matching.scoring import Deployed
from ledgerloom.plans import reconcile as rec

SCHEMA = "session_id string, txn_id long, date date, vendor string, amount double, description string"
WORDS = ["Coffee", "Shop", "Shell", "Gas", "A", "Store", "&", "Co", ""]


def side(spark, rnd, n, ids):
    """Rows with missing values, odd amounts, empty texts and, if ``ids`` are few, repeated ids."""

    def row(i):
        day = rnd.choice([None, *(dt.date(2024, 1, d) for d in range(1, 6))])
        vendor = rnd.choice([None, " ".join(rnd.choices(WORDS, k=rnd.randrange(4)))]) if rnd.random() < 0.3 else " ".join(rnd.choices(WORDS, k=2))
        odd = [None, 0.0, -5.0, float("nan"), float("inf"), -float("inf")]
        amount = rnd.choice(odd) if rnd.random() < 0.2 else round(rnd.uniform(90, 110), 2)
        return ("s" if i % 9 else "t", i % ids, day, vendor, amount, rnd.choice([None, "", "Fuel", "Fuel gas", "x"]))

    return spark.createDataFrame([row(i) for i in range(n)], SCHEMA)


@pytest.mark.parametrize("ids", [150, 70])
@pytest.mark.parametrize("rules", [Deployed(), Deployed(threshold=0.55)])
def test_whole_sessions_are_the_fold(spark, ids, rules):
    rnd = random.Random(ids)
    led, stm = rec.prepared(side(spark, rnd, 150, ids), side(spark, rnd, 150, ids), rules)
    got, want = whole.settle_whole(led, stm, rules), rec._assign_small(led, stm, rules)
    names = ["session_id", "led", "stmt", "score"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))


def test_a_large_session_needs_no_candidate_lists(spark, monkeypatch):
    rnd = random.Random(3)
    led, stm = side(spark, rnd, 160, 160), side(spark, rnd, 160, 160)
    want = rec.reconcile(led, stm, small_session_pairs=10**6).matches.collect()

    def never(*args):
        raise AssertionError("lists of candidates for a session that one task can settle")

    monkeypatch.setattr(rec.cand, "phase_edges", never)
    # The session has 20,000 pairs, more than are paired row by row.
    assert sorted(rec.reconcile(led, stm).matches.collect()) == sorted(want)


def test_parts_of_nested_documents_move_once(spark):
    rnd = random.Random(5)
    result = rec.reconcile(side(spark, rnd, 40, 40), side(spark, rnd, 40, 40))
    nested = result.nested_documents(records_per_part=4)
    # Empty lists are found by names; finished parts meet no other table.
    assert "LeftOuter" not in nested._jdf.queryExecution().optimizedPlan().toString()
    assert nested.groupBy("session_id").agg(F.count_distinct("list").alias("n")).where("n != 7").count() == 0


def never(*args):
    raise AssertionError("candidate lists or joins for a session that one task can settle")


def test_sessions_of_many_pairs_are_settled_in_a_task(spark, monkeypatch):
    rnd = random.Random(7)
    # 360,000 pairs, more than 2**18 times the bound of a small session.
    led, stm = (side(spark, rnd, 600, 600).withColumn("session_id", F.lit("s")) for _ in range(2))
    monkeypatch.setattr(rec.cand, "phase_edges", never)
    result = rec.reconcile(led, stm, small_session_pairs=1)
    assert sorted(map(tuple, whole.settle_whole(*rec.prepared(led, stm, Deployed()), Deployed()).select("led", "stmt").collect())) == sorted(
        map(tuple, result.matches.select("ledger_txn_id", "statement_txn_id").collect())
    )
    # Both rows of a pair come from its task; the sides are not joined to it.
    assert "Join" not in result.matches._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("ids", [90, 30])
def test_matches_of_a_task_are_those_of_the_fold(spark, ids):
    rnd = random.Random(ids)
    led, stm = (side(spark, rnd, 90, ids).withColumn("session_id", F.lit("s")) for _ in range(2))
    few = [side(spark, rnd, 12, 12).withColumn("session_id", F.lit(None if k else "few").cast("string")) for k in (0, 1)]
    one = side(spark, rnd, 5, 5).withColumn("session_id", F.lit("one side"))
    led, stm = led.unionByName(few[0]).unionByName(few[1]).unionByName(one), stm.unionByName(few[0]).unionByName(few[1])
    want = rec.reconcile(led, stm, small_session_pairs=10**6).matches.collect()
    for bound in (100, 1000):
        assert sorted(rec.reconcile(led, stm, small_session_pairs=bound).matches.collect()) == sorted(want)


def test_sessions_of_too_many_rows_go_in_blocks(spark, monkeypatch):
    rnd = random.Random(9)
    finite = F.when(F.abs("amount") < 1000, F.col("amount"))
    led, stm = (side(spark, rnd, n, n).withColumns({"session_id": F.lit("s"), "amount": finite}) for n in (30, 12))
    want = sorted(rec.reconcile(led, stm, small_session_pairs=100).matches.collect())
    monkeypatch.setattr(rec, "WHOLE_SESSION_ROWS", 40)
    monkeypatch.setattr(rec, "matched_rows", never)
    assert sorted(rec.reconcile(led, stm, small_session_pairs=100).matches.collect()) == want


def table(rows):
    ids, days, vendors, amounts, texts = zip(*(r[1:] for r in rows))
    columns = [pa.array(ids, pa.int64()), pa.array(days, pa.date32()), pa.array(vendors, pa.string())]
    columns += [pa.array(amounts, pa.float64()), pa.array(texts, pa.string())]
    return pa.table(columns, ["id", "date", "vendor", "amount", "description"]).sort_by("id")


@pytest.mark.parametrize(
    "at_once", [{}, {"ROWS_AT_ONCE": 7, "MOST_OF_A_ROW": 3}, {"PAIRS_AT_ONCE": 30, "FREQUENT": 1, "FEW_CLASSES": 0}, {"MANY_TEXTS": 1, "KEPT_LEVELS": 50}]
)
def test_no_bound_changes_the_serial_order(monkeypatch, at_once):
    for name, value in at_once.items():
        monkeypatch.setattr(whole, name, value)
    names = ["session_id", "txn_id", "date", "vendor", "amount", "description"]
    words = ["COFFEE", "SHOP", "A", "STORE", "LARGE RING", "BRAND#1", "BRAND#12"]
    for seed in range(12):
        rnd = random.Random(seed)

        def row(i):
            day = rnd.choice([None, *(dt.date(2024, 1, d) for d in range(1, 2 + seed))])
            vendor = rnd.choice([None, *(" ".join(rnd.choices(words, k=rnd.randrange(4))) for _ in range(9))])
            amount = rnd.choice([None, 0.0, -5.0] + [round(rnd.uniform(90, 110), 2)] * 9)
            return ("s", i, day, vendor, amount, rnd.choice([None, "", "FUEL", "FUEL GAS", "X"]))

        # Copies share a class and are taken in the order of their ids.
        led = [row(i) for i in range(40)]
        led += [("s", 100 + r[1], *r[2:]) for r in led[:15] * 2][:15]
        stm = [row(i) for i in range(50)]
        found = whole._serial(table(led), table(stm), Deployed())
        assert dict(zip(found[1], found[0])) == plain.serial(*([dict(zip(names, r)) for r in x] for x in (led, stm)), "deployed")


def test_white_space_is_that_of_the_jvm(spark):
    rows = [("a" + chr(i) + "b",) for i in range(1, 0x10000) if not 0xD800 <= i <= 0xDFFF]
    split = spark.createDataFrame(rows, "x string").where(F.size(text.words(F.col("x"))) == 2).collect()
    assert [r.x for r in split] == [x for (x,) in rows if len([w for w in whole._SPACE.split(x) if w]) == 2] != []
