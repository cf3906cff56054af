import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text, values
from ledgerloom.operators import anomalies, clean, documents, monthly, summary
from ledgerloom.operators.quantiles import exact_quantiles
from ledgerloom.operators.ranking import spread_row_number
from ledgerloom.plans import analysis
from ledgerloom.sources import ledgers, sessions, sinks

RAW = [
    ("2024-01-05", "Shell", "45.00", "Fuel", "Gas"),
    ("2024-01-06", "Shell", "abc", "Fuel", "Gas"),
    ("not a date", "Shell", "1", "Fuel", "Gas"),
    ("01/07/2024", "Cafe", "4.5", None, "Coffee"),
    ("2024-02-01", "N/A", "3", "Food", "x"),
    ("2024-02-02", "Cafe", "1,000", "Food", "x"),
    ("2024-02-03", "Depot", "nan", "Office", "x"),
    ("2024-02-04", "Depot", "12.25", "Office", "x"),
    ("2024-02-05", "Depot", "1d", "Office", "x"),
]
COLUMNS = "date string, vendor string, amount string, category string, description string"


def test_clean_ledger(spark):
    raw = spark.createDataFrame(RAW, COLUMNS)
    rows = clean.clean_ledger(raw, ("MM/dd/yyyy",)).orderBy("date").collect()
    assert [(r.date, r.vendor, r.amount) for r in rows] == [
        (dt.date(2024, 1, 5), "Shell", 45.0),
        (dt.date(2024, 1, 7), "Cafe", 4.5),
        (dt.date(2024, 2, 4), "Depot", 12.25),
    ]
    typed = clean.coerce(raw, ("MM/dd/yyyy",))
    assert clean.check_usable(typed) == "Successfully loaded 3 transactions (6 invalid rows removed)"
    kept, seen = clean.with_rejects(typed)
    assert kept.count() == 3 and seen.get["rows_removed"] == 6


def test_unusable_ledgers_raise(spark):
    raw = spark.createDataFrame(RAW, COLUMNS)
    with pytest.raises(clean.LedgerError, match="vendor"):
        clean.require_columns(raw.drop("vendor"))
    with pytest.raises(clean.LedgerError, match="empty"):
        clean.check_usable(clean.coerce(raw.limit(0)))
    with pytest.raises(clean.LedgerError, match="dates"):
        clean.check_usable(clean.coerce(raw.withColumn("date", F.lit("?"))))
    with pytest.raises(clean.LedgerError, match="valid rows"):
        clean.check_usable(clean.coerce(raw.withColumn("amount", F.lit("?"))))


def test_vendor_default(spark):
    raw = spark.createDataFrame(RAW, COLUMNS).drop("vendor")
    assert clean.vendor_default(raw).first().vendor == "Gas"
    assert clean.vendor_default(raw.drop("description")).first().vendor == "Unknown"


def test_text_forms(spark):
    df = spark.createDataFrame([("  Joe's   Diner LLC ",), ("The Joe & Co",), ("AT&T Inc",)], "t string")
    got = df.select(text.clean_text(F.col("t")), text.standard_vendor(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [
        ("JOE'S DINER", "Joe'S Diner"), ("JOE", "The Joe"), ("AT&T", "At&T")
    ]


def test_csv_files_and_text(spark, tmp_path):
    body = "date,vendor,amount,category,description\n" + "".join(
        f"2024-03-{1 + i % 28:02d},V{i},{i}.5,C,\"a, \"\"b\"\"\"\n" for i in range(40)
    )
    path = tmp_path / "ledger.csv"
    path.write_text(body)
    rows = ledgers.read_csv(spark, str(path), numbered=True).orderBy("txn_id").collect()
    assert [r.txn_id for r in rows] == list(range(40)) and rows[7].vendor == "V7"
    assert rows[0].description == 'a, "b"'
    loaded, status = ledgers.load_ledger(spark, str(path))
    assert loaded.count() == 40 and status == "Successfully loaded 40 transactions"
    assert ledgers.csv_from_text(spark, body).count() == 40
    out = str(tmp_path / "out")
    sinks.write_csv(loaded, out)
    assert clean.clean_ledger(ledgers.read_csv(spark, out)).exceptAll(loaded).isEmpty()
    lines = spark.createDataFrame([("s", "2024-01-01,A,2")], "session_id string, line string")
    assert ledgers.csv_from_column(lines, "line", ["date", "vendor", "amount"]).first().vendor == "A"


def test_images(spark, tmp_path):
    (tmp_path / "scan.png").write_bytes(b"\x89PNG123")
    row = ledgers.read_images(spark, str(tmp_path)).first()
    assert (row.filename, row.bytes, row.image_base64) == ("scan.png", 7, "iVBORzEyMw==")


def test_sessions(spark, tmp_path):
    store = sessions.SessionStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("007", 1), ("007", 2), ("b", 3)], "session_id string, txn_id long")
    store.upsert("ledger", rows)
    store.upsert("ledger", rows.where("session_id = 'b'").withColumn("txn_id", F.lit(9)))
    assert sorted(r.txn_id for r in store.lookup("ledger", "007").collect()) == [1, 2]
    assert [r.txn_id for r in store.lookup("ledger", "b").collect()] == [9]
    with pytest.raises(sessions.SessionNotFound):
        store.lookup("ledger", "missing")
    store.activate(rows)
    assert sessions.session_count(store.read("active")).first().session_count == 2
    made = spark.range(1).select(sessions.new_session_id().alias("i")).first().i
    assert len(made) == len("session_00000000_20240101_000000")


def test_summary_of_sample(spark):
    rows = ledgers.sample_ledger(spark)
    one = summary.ledger_summary(rows).first()
    assert (one.transaction_count, one.total_amount) == (5, 192.23)
    assert [r.category for r in summary.top_categories(rows).collect()] == [
        "Software", "Vehicle Expenses", "Office Supplies"
    ]
    report = summary.summary_text(rows).first().report
    assert "• Total Amount: $192.23" in report and "• Software: $99.99" in report
    assert summary.vendor_total(rows, "nobody").count() == 0
    assert summary.category_total(rows, "nothing").first().total_amount == 0.0


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_exact_quantiles(spark, buckets):
    rng = np.random.default_rng(3)
    data = [("a", float(x)) for x in rng.lognormal(3, 2, 301)] + [("b", 5.0)] * 50 + [("c", -2.0), ("c", 8.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = exact_quantiles(df, ["k"], "v", {"p95": 0.95, "q1": 0.25}, buckets).collect()
    for row in got:
        own = [v for k, v in data if k == row.k]
        assert row.p95 == pytest.approx(np.quantile(own, 0.95), rel=1e-12)
        assert row.q1 == pytest.approx(np.quantile(own, 0.25), rel=1e-12)
    assert len(got) == 3


def test_spread_row_number(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).alias("o"))
    got = spread_row_number(df, ["k"], F.col("o"), F.floor(F.col("o") / 50), "n").collect()
    for key in range(3):
        mine = sorted((r.o, r.n) for r in got if r.k == key)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_large_rows_continue_on_more_pages(spark):
    rows = spark.range(400).select(
        F.col("id").alias("txn_id"),
        F.to_date(F.lit("2024-01-15")).alias("date"),
        F.lit("V").alias("vendor"),
        F.col("id").cast("double").alias("amount"),
        F.lit("C").alias("category"),
    )
    docs = documents.monthly_documents(rows, rows_per_page=8).orderBy("doc_id").collect()
    assert [d.doc_id for d in docs] == ["month-2024-01", "month-2024-01-1", "month-2024-01-2"]
    lines = [x for d in docs for x in d.text.split("\n") if x.startswith("2024-01-15 V")]
    assert len(lines) == monthly.month_large_txns(rows).count() == 20


def test_missing_category_column(spark):
    rows = ledgers.sample_ledger(spark).drop("category").withColumn("txn_id", F.monotonically_increasing_id())
    assert monthly.month_top_category(rows).first().top_category == "Unknown"
    assert "CATEGORY BREAKDOWN:\n{}" in documents.monthly_documents(rows).first().text


def test_amount_coercion(spark):
    cases = {"12.5": 12.5, " 7 ": 7.0, "1e2": 100.0, "inf": None, "nan": None, "": None, "0x10": None, "-.5": -0.5}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.v for r in df.select("t", values.to_amount(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_surplus_fields_and_overflow_are_not_silent(spark):
    with pytest.raises(clean.LedgerError, match="Record 3"):
        ledgers.csv_from_text(spark, "date,vendor\n2024-01-01,a\n2024-01-02,b,c\n")
    fits = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,)], "amount double")
    assert fits.agg(values.total(F.col("amount")).alias("t")).first().t == 1
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        spark.createDataFrame([(1e30,)], "amount double").agg(values.total(F.col("amount"))).collect()


def test_ledger_analysis_gives_every_row_a_vendor(spark):
    raw = spark.createDataFrame(
        [("2024-01-01", "5", "Fuel"), ("2024-01-02", "x", "Fuel"), (None, "7", "Fuel")], "date string, amount string, description string"
    )
    found = analysis.analyze_ledger(raw)
    assert [(r.section, r.name, r.transaction_count, r.total_amount) for r in found.sections().collect()] == [
        ("ledger", "all", 1, 5.0), ("vendor", "Fuel", 1, 5.0)
    ]
    assert analysis.analyze_ledger(raw.drop("description")).transactions.first().vendor == "Unknown"
    with pytest.raises(clean.LedgerError):
        analysis.spending_by_category(raw)


def test_matching_analyses_leave_out_rows_without_amount(spark):
    raw = spark.createDataFrame(
        [("a", "Eco", "1.5"), ("a", "Eco", None), (None, "eco", "2"), ("b", None, "3")], "vendor string, category string, amount string"
    )
    assert tuple(analysis.spending_by_category(raw, "eco").first()) == ("eco", 3.5, 2)
    assert {tuple(r) for r in analysis.vendor_analysis(raw).collect()} == {("a", 1.5, 1, 1.5), ("b", 3.0, 1, 3.0)}
    assert tuple(analysis.vendor_analysis(raw, "a").first()) == ("a", 1.5, 1, 1.5)


def test_session_versions_share_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sessions, "BUCKETS", 1)
    store = sessions.SessionStore(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(r, "session_id string, n long")
    store.upsert("ledger", rows(("1", 1), ("1", 2), ("02", 3), (None, 4)))
    store.upsert("ledger", rows(("1", 9)))
    assert {(r.session_id, r.n) for r in store.read("ledger").collect()} == {("02", 3), ("1", 9), (None, 4)}
    assert [r.n for r in store.lookup("ledger", "1").collect()] == [9]
    assert store.lookup("ledger", "02").columns == ["session_id", "n", "created_at"]


def _month_rows(spark, months):
    rows = []
    for k, month in enumerate(months):
        for n in range(12 + 5 * (k % 3)):
            vendor = ["Shell", "Cafe", "Depot", f"New {k}"][n % 4]
            rows.append((dt.date(*month, 1 + n), vendor, 10.0 + n * (1 + k % 4) + (400 if n == 7 and k % 2 else 0), ["Fuel", "Food", None][n % 3], k * 100 + n))
    return spark.createDataFrame(rows, "date date, vendor string, amount double, category string, txn_id long")


def test_a_month_added_to_a_rollup_equals_the_whole(spark):
    months = [(2023, 11), (2023, 12), (2024, 1), (2024, 2), (2024, 11)]
    old, new = _month_rows(spark, months[:3]), _month_rows(spark, months).where("date >= '2024-02-01'")
    whole = _month_rows(spark, months)
    rolled = monthly.rollup(old).unionByName(monthly.rollup(new))
    for op in (monthly.monthly_stats, monthly.month_category, monthly.month_vendor, monthly.month_top_category,
               monthly.month_top_vendors, monthly.month_frequent_vendors, monthly.month_daily,
               anomalies.month_over_month, anomalies.category_deviation, anomalies.frequency_spikes, anomalies.seasonal_spikes):
        found, wanted = op(rolled), op(whole)
        assert found.schema.simpleString() == wanted.schema.simpleString(), op.__name__
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())), op.__name__
    kept = anomalies.anomalies(whole, rolled=rolled).collect()
    assert kept and sorted(map(str, kept)) == sorted(map(str, anomalies.anomalies(whole).collect()))
