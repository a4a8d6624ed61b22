"""Plans: what reaches the scan, and what is not read or shuffled twice."""

import os
import re

import pytest

import __spark_entry__ as entry
from cairn.operators import gc, orphans
from cairn.plans.fixtures import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def schemas(text):
    return re.findall(r"ReadSchema: struct<(.*?)>(?=\n|$)", text)


def test_delta_reads_only_what_it_compares(spark):
    text = plan(entry.queries()["p5_found"](spark, DATA))
    lists = [s for s in schemas(text) if "path:" in s]
    assert lists and all("chunks" not in s and "extra" not in s and "mime" not in s for s in lists)


def test_history_reads_no_file_lists(spark):
    text = plan(entry.queries()["log_all_paged"](spark, DATA))
    assert "file_entries" not in text


def test_filters_reach_the_scan(spark):
    assert "IsNull(deleted_at)" in plan(gc.stored_chunks(table(spark, DATA, "chunks")))


def test_references_are_scanned_once(spark):
    names = ("file_entries", "snapshots", "chunks", "base_chunks")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = orphans.missing_chunks(*(table(spark, DATA, n) for n in names))
        df.collect()
        assert plan(df).count("ReusedExchange") >= 2 and "BroadcastExchange" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
