"""Every catalog query gives the rows of its SQL twin on the smallest tables."""

import pytest
from compare import differences, run_query, run_sql

from pagemill.catalog import ORACLES, QUERIES

NO_SQL = {"scalar_ciphers"}


def test_only_these_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    got = run_query(QUERIES[name](spark, sf))
    assert got[1], "no rows"
    if name in ORACLES:
        report = differences(got, run_sql(con, ORACLES[name]))
        assert report == "", report


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
