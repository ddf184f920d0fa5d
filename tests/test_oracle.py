"""Every registered query against its DuckDB oracle (the driver's gate)."""

import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare
from tests.conftest import SF_ORACLE

SQLS = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, duck, name):
    r = compare(spark, duck, name, QUERIES[name], SQLS[name], SF_ORACLE)
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQLS)))
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SF_ORACLE)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "name", "image1", "price"]
    assert df.count() > 0
