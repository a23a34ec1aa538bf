"""Every registered query of this package against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tracklake import queries

DATA = os.environ.get("TRACKLAKE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float)):
        return None if math.isnan(value) else float(value)
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cursor = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    at = [columns.index(c) for c in sorted(columns)]
    want = sorted((tuple(plain(row[i]) for i in at) for row in cursor.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(columns) and got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
