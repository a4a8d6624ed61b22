from datetime import datetime

from helpers import h

from cairn.operators import orphans

T0, T1, T2 = (datetime(2025, m, 1) for m in (1, 2, 3))
E = "entry_id bigint, snapshot_id string, chunks array<string>, key string, at string"
R = "ref_id bigint, target string, updated_at timestamp, key int"
C = "run_id bigint, snapshot_id string, ran_at timestamp, missing bigint"
S = "snapshot_id string, ts bigint, deleted_at timestamp"
K = "hash string, stored_at timestamp, deleted_at timestamp, since int"


def run(spark, rows, entries=(), refs=(), runs=(), snaps=(), chunks=(), base=()):
    tables = [spark.createDataFrame(list(x), k) for x, k in ((entries, E), (refs, R), (runs, C), (snaps, S), (chunks, K), ([(b,) for b in base], "hash string"))]
    return rows(orphans.dangling_references(*tables))


def ts(t):
    return int((t - datetime(1970, 1, 1)).total_seconds())


def test_chunks(spark, rows):
    s = h("s")
    entries = [(1, s, [h("ok"), h("gone"), h("gone").upper(), None, "bad", h("base")], "k", "a"), (1, s, [h("ok"), h("gone"), h("gone").upper(), None, "bad", h("base")], "k", "a"), (2, s, [h("dead"), h("late"), h("back")], "k", "a"), (3, s, None, "k", "a"), (4, s, [], "k", "a")]
    chunks = [(h("ok"), T0, None, 1), (h("dead"), T0, T1, 1), (h("late"), T2, None, 1), (h("back"), T0, T1, 1), (h("back"), T2, None, 1), ("x", T0, None, 1), (None, T0, None, 1)]
    got = run(spark, rows, entries, snaps=[(s, ts(T1), None), (s, ts(T1), None)], chunks=chunks, base=[h("base")], runs=[(1, s, T2, 3), (2, s, T2, 2), (3, s, T2, None), (4, h("no"), T2, 0), (5, None, T2, 9)])
    want = [("file_entries", "1", "2025-02", h("gone")), ("file_entries", "2", "2025-02", h("dead")), ("file_entries", "2", "2025-02", h("late"))]
    want += [("check_runs", "2", "2025-03", s), ("check_runs", "3", "2025-03", s), ("check_runs", "4", "2025-03", h("no"))]
    assert got == sorted(want, key=repr)


def test_refs(spark, rows):
    snaps = [(h("live"), ts(T0), None), (h("dead"), ts(T0), T1), (h("both"), ts(T0), T1), (h("both"), ts(T0), None), (h("late"), ts(T2), None)]
    refs = [(k, t, T1, 0) for k, t in enumerate([h("live"), h("dead"), h("both"), h("late"), h("none"), None, "0" * 64])]
    got = run(spark, rows, refs=refs + refs[:2], snaps=snaps)
    assert got == [("refs", str(k), "2025-02", h(n)) for k, n in ((1, "dead"), (3, "late"), (4, "none"))]


def test_empty(spark, rows):
    assert run(spark, rows) == []


def test_hot_key(spark):
    refs = spark.range(5000).selectExpr("case when id % 3 = 0 then 0 else id end as key", "timestamp'2025-01-01' as at", "id")
    parents = spark.range(1, 4000).selectExpr("id as key", "timestamp'2024-01-01' as since")
    assert orphans.orphan_rows(refs, parents).count() == sum(1 for k in range(5000) if k % 3 == 0 or k >= 4000)


def test_report(spark, rows):
    df = spark.createDataFrame([("a", "2025-01", "x"), ("a", "2025-01", "x"), ("a", "2025-01", "y"), ("b", None, "x")], "ref_table string, period string, target string")
    assert rows(orphans.orphan_report(df)) == [("a", "2025-01", 3, 2), ("b", None, 1, 1)]
