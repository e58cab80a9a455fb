"""Every query that has SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from denspark import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    found = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    key = lambda row: tuple((x is None, x) for x in row)
    want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=key) == want
