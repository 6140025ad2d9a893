"""Every registered query with an oracle matches DuckDB on sf0.001."""

import os

import pytest

from oracle_check import check, duck

SF = "/root/testdata/sf0.001"


def _names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as E
    con = duck(SF)
    r = check(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert r["schema"] and r["rows"] == r["oracle_rows"] and r["exact"], r


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns
