"""Every registered query next to its SQL on the smallest sample tables."""

import os

import pytest

import __spark_entry__ as contract
from workload.check import compare, connect
from workload.oracle import ORACLE
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    good, note = compare(spark, con, name, FOLDER)
    assert good, note


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "order_count", "order_total", "recent_orders"] and df.count() == 150
