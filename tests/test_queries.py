"""Every registered query against its DuckDB statement at the smallest size."""

import decimal
import os

import duckdb
import pytest

from tidemark import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return str(float(v))
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_duckdb(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert found
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
