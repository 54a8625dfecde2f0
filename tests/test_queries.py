"""Every registered query against its check SQL at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract  # noqa: E402
from oracle_check import compare, connect  # noqa: E402

from registry.catalogue import all_queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
#: The queries of this registry; those of the optional subpackage are tested with it.
OWN = all_queries()
QUERIES = {name: build for name, build in contract.queries().items() if name in OWN}
CHECKS = {name: sql for name, sql in contract.oracle_sql().items() if name in OWN}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_check(spark, con, name):
    verdict, _ = compare(QUERIES[name](spark, FOLDER), con, CHECKS.get(name))
    assert verdict in ("ok", "rows only"), verdict


def test_every_query_has_a_check():
    assert set(CHECKS) == set(QUERIES)


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "score" in df.columns
