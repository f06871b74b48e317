"""Every registered query against its oracle on the smallest data set."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module
from repotide.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    _, problems = compare(con, QUERIES[name](spark, SF), ORACLES[name])
    assert not problems


def test_entry(spark):
    df = entry_module.entry(spark)
    assert {"repo_id", "dir", "status"} <= set(df.columns)
    assert df.count() > 0
