"""Every registered query next to its SQL, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, small, name):
    result = check.check(spark, con, small, name)
    assert not result.startswith("FAIL"), result


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["user_id", "window_ms", "person_event", "auction_event", "value"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
