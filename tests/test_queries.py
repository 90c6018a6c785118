"""Every registered query against its DuckDB oracle on sf0.001, and the
driver's smoke entry."""

import pytest

import __spark_entry__ as entry
from tests.oracle_harness import compare, duck_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, name):
    fn = entry.queries()[name]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, SF).count() >= 0
        return
    ok, msg = compare(spark, con, SF, name, fn, sql)
    assert ok, msg
