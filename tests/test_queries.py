"""Every query over the smallest test tables, against its SQL where it has one."""

import os
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
OWN = [n for n in entry.queries() if not re.match(r"p[14678]_", n)]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(x):
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return float(x) if isinstance(x, float) else x


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == sorted(df.columns)
        order = ", ".join(f'"{c}"' for c in sorted(want.columns))
        assert got == sorted((tuple(plain(x) for x in r) for r in duck.sql(f"SELECT {order} FROM ({sql})").fetchall()), key=repr)
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
