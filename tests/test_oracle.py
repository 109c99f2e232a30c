"""Every query with SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = [n for n in entry.queries() if not (n[:2] == "op" and n[2].isdigit()) and n != "pipeline"]


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, "" if x is None else str(type(x)), 0 if x is None else x) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in entry.oracle_sql():
        assert got  # what SQL cannot say is held against brute force elsewhere
        return
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    order = [want.columns.index(c) for c in sorted(df.columns)]
    assert ordered(got) == ordered([tuple(plain(r[i]) for i in order) for r in want.fetchall()])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
