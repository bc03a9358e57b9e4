"""Two-engine check: each registered query against its DuckDB oracle
(order-insensitive, exact values and types) on the smallest scale."""

import pytest

from tally.checks import compare as cmp
from tally.checks.oracle_sql import ORACLE_SQL
from tally.plans.queries import QUERIES

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return cmp.duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle(spark, con, key):
    r = cmp.compare(spark, key, SF_SMALL, con)
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"] and r["exact_match"] and r["types_match"], r


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["customer_name", "opening_balance", "invoiced_amount", "return_amount",
                          "paid_amount", "closing_balance", "currency"]
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.oracle_sql())
