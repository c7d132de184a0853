"""Every named query against its SQL counterpart, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from shelfwright.plans.oracle import ORACLES
from shelfwright.plans.registry import QUERIES
from tests.compare import connect, difference

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert difference(driver.queries()[name](spark, PATH), con, driver.oracle_sql()[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
