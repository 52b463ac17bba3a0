"""Every query with a SQL twin gives the same rows on a second engine."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for f in sorted(Path(small).glob("*.parquet")):
        con.execute(f"CREATE VIEW \"{f.stem}\" AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, db, name):
    df = __spark_entry__.queries()[name](spark, small)
    cursor = db.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(columns, cursor.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, float) for x in (*a, *b)) else all(
            x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True)
        ), (a, b)


def test_names_match():
    assert set(SQL) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
