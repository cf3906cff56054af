import pytest

import __spark_entry__ as entry
from compare import differences, duck
from ledgerloom.plans.catalog import QUERIES
from ledgerloom.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert differences(spark, con, sf, entry.queries()[name], entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_paged_documents_equal_sql(spark, sf, con):
    from ledgerloom.operators import documents
    from ledgerloom.plans import bindings, oracles

    def paged(spark, sf):
        docs = documents.monthly_documents(bindings.ledger(spark, sf), rows_per_page=3)
        return docs.select("doc_id", "document_type", "text", "metadata.period", "metadata.year", "metadata.month", "metadata.top_category")

    assert differences(spark, con, sf, paged, oracles.monthly_doc(3)) == ""
    rows = bindings.ledger(spark, sf)
    stats = documents.index_stats(rows, True, 3).first()
    assert stats.document_count == paged(spark, sf).count() + rows.count()


def test_entry(spark):
    assert entry.entry(spark).count() == 150
