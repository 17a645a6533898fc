"""Every registered query against DuckDB on the same tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

SCALES = os.environ.get("ORACLE_SCALES", "sf0.01").split(",")
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="session", params=SCALES)
def tables(request):
    sf_dir = f"/root/testdata/{request.param}"
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    yield sf_dir, con
    con.close()


def rows_by_column_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([row[i] for i in order] for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, tables, name):
    sf_dir, con = tables
    df = contract.queries()[name](spark, sf_dir)
    expected = con.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_by_column_name(df.columns, df.collect()) == rows_by_column_name(names, expected.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


def test_entry_is_lazy_and_has_rows(spark):
    assert contract.entry(spark).count() == 10
