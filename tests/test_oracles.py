"""Registered queries against their SQL twins, on the smallest tables: the headline queries, or
all of them with COMPARE_ALL=1 (tests/compare.py does the same at any scale)."""

import os

import pytest

from bench import HEADLINE
from __spark_entry__ import entry, oracle_sql, queries
from bidweave.plans import all_queries
from compare import check, connect

FOLDER = "/root/testdata/sf0.001"
OWN = sorted(all_queries())  # the optional subpackage has its own tests
NAMES = OWN if os.environ.get("COMPARE_ALL") else HEADLINE


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = check(spark, con, queries()[name], oracle_sql().get(name), FOLDER, need_rows=False)
    assert ok, note


def test_names_and_sql_belong_together():
    assert set(oracle_sql()) <= set(queries()) and len(set(OWN) - set(oracle_sql())) == 1


def test_entry(spark):
    assert entry(spark).count() > 0
