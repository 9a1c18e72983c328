"""Every registered query beside its SQL twin."""

import pytest

import __spark_entry__ as entry
from casemill.plans import catalog
from compare import compare, duck

SQL = catalog.SQL


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, con, name):
    problem = compare(entry.queries()[name](spark, folder), con, SQL[name])
    # The smallest tables leave a few lists empty on both sides.
    assert problem in (None, "no rows on either side"), problem


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_is_lazy_and_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "recall_system" in df.columns
