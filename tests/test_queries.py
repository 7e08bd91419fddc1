"""Every registered query against DuckDB, and the driver contract."""

import pytest
from conftest import SMALL
from oracle_check import connect, differences

import __spark_entry__ as contract
from tallylog.plans.queries import all_queries

NAMES = sorted(all_queries())


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(NAMES) <= set(contract.oracle_sql()) & set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    frame = contract.queries()[name](spark, SMALL)
    assert differences(frame, duck, contract.oracle_sql()[name]) is None


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["start", "group", "count"]
    assert frame.count() > 0
