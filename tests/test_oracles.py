"""Every registered query with an oracle equals its DuckDB twin at sf0.01 (rows, columns, values)."""

import pytest

import __spark_entry__ as E
from paths import SF01
from oracle_compare import compare

ORACLE = sorted(E.oracle_sql())


def test_every_query_registered_has_callable():
    q = E.queries()
    assert set(E.oracle_sql()) <= set(q)
    assert len(q) >= 60


@pytest.mark.parametrize("name", ORACLE)
def test_oracle(spark, con01, name):
    r = compare(E.queries()[name](spark, SF01), con01, E.oracle_sql()[name])
    assert r["cols_match"], r
    assert r["rows_match"], r
    assert r["hash_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["datetime_15min", "prediction"]
    assert df.count() > 0
