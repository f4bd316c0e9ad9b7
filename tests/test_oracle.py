"""Every registered query runs on the smallest tables, and equals its SQL twin."""

import duckdb
import pytest

import __spark_entry__ as entry
from leadloom.domain import BASE_TABLES
from tools.compare import rows_of

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_oracle_keys_are_registered():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns, got = rows_of(df.columns, df.collect())
    if name in ORACLE:
        rel = con.execute(ORACLE[name])
        expected_columns, want = rows_of([d[0] for d in rel.description], rel.fetchall())
        assert columns == expected_columns
        assert got == want
