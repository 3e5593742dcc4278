"""Every registered job with an oracle against DuckDB on sf0.001 (the driver
runs the same comparison at sf0.01).  Heavy model jobs are rows-only."""

import pytest

import __spark_entry__ as E
from harness import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    r = compare(E.queries()[name](spark, SF), con, E.oracle_sql()[name])
    assert r["schema_match"] and r["rows_match"] and r["values_match"], r
