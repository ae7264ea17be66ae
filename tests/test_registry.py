"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from checks.compare import compare, duck
from checks.oracle import ORACLES
from checks.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, SMALL), duck(SMALL), ORACLES[name]) == ""
