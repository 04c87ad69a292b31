"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from sunmelt.workload.check import compare

SMALL = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, name):
    df = contract.queries()[name](spark, SMALL)
    if name in SQL:
        assert compare(df, SQL[name], SMALL) is None
    else:
        assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(contract.queries())


def test_flagship(spark):
    assert contract.entry(spark).count() > 0
