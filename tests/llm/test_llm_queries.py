"""The registered queries over the smallest test tables."""

import os
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
COLUMNS = {"p1_found": ["first_entry_id", "entry_id"], "p4_found": ["put_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "seg_no", "lang"]}


@pytest.mark.parametrize("name", [n for n in entry.queries() if re.match(r"p[14678]_", n)])
def test_query(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and len(set(rows)) == len(rows)
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_known_puts_as_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("chunk_puts", "base_chunks"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = sorted(con.sql(entry.oracle_sql()["p4_found"]).fetchall())
    assert sorted(tuple(r) for r in entry.queries()["p4_found"](spark, DATA).collect()) == want
