"""Every registered query against its oracle, on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from grainsieve.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, con, name):
    oracles = entry.oracle_sql()
    df = entry.queries()[name](spark, FOLDER)
    assert compare(df, con, oracles[name]) is None


def test_every_query_of_the_scans_has_an_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["category", "data_type", "severity", "occurrences", "files"]
