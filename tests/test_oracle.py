"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from wicketry import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in ("lineitem", "orders", "customer"):
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    assert got == want


def test_every_query_has_sql():
    assert set(SQL) == set(registry.queries())
