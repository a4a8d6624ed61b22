"""Queries p2, p3 and p5 over the domain tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.operators import orphans, reconcile, snapshot_delta


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    names = ("file_entries", "refs", "check_runs", "snapshots", "chunks", "base_chunks")
    return orphans.dangling_references(*(table(spark, d, x) for x in names))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.store_differences(*(table(spark, d, x) for x in ("chunks", "remote_chunks", "refs", "remote_refs")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_delta.snapshot_changes(table(spark, d, "file_entries"), table(spark, d, "snapshots"))


def _sql_hash(column: str) -> str:
    plain = f"lower(regexp_replace({column}, '[\\s\\p{{Z}}/]+', '', 'g'))"
    return f"CASE WHEN regexp_full_match({plain}, '[0-9a-f]{{64}}') AND {plain} <> repeat('0', 64) THEN {plain} END"


_SNAPSHOT_STATE = f"""
ids AS (SELECT {_sql_hash("snapshot_id")} AS sid, min(ts) AS ts, bool_or(deleted_at IS NULL) AS live FROM snapshots
        WHERE {_sql_hash("snapshot_id")} IS NOT NULL GROUP BY 1)"""

_P2 = f"""WITH {_SNAPSHOT_STATE},
store AS (SELECT {_sql_hash("hash")} AS h, min(stored_at) AS since, bool_or(deleted_at IS NULL) AS live FROM chunks GROUP BY 1),
base AS (SELECT {_sql_hash("hash")} AS h FROM base_chunks),
listed AS (SELECT DISTINCT entry_id, sid, {_sql_hash("c")} AS h FROM (
    SELECT entry_id, {_sql_hash("snapshot_id")} AS sid, unnest(chunks) AS c FROM file_entries) x),
gone AS (SELECT l.entry_id, l.sid, to_timestamp(i.ts) AT TIME ZONE 'UTC' AS seen, l.h FROM listed l LEFT JOIN ids i USING (sid) LEFT JOIN store s ON s.h = l.h
    WHERE l.h IS NOT NULL AND l.h NOT IN (SELECT h FROM base WHERE h IS NOT NULL)
      AND (NOT coalesce(s.live, false) OR s.since > to_timestamp(i.ts) AT TIME ZONE 'UTC')),
heads AS (SELECT DISTINCT ref_id, updated_at, {_sql_hash("target")} AS h FROM refs),
runs AS (SELECT DISTINCT run_id, ran_at, missing, {_sql_hash("snapshot_id")} AS h FROM check_runs),
counts AS (SELECT sid, count(DISTINCT h) AS n FROM gone GROUP BY 1),
found AS (
SELECT 'file_entries' AS ref_table, CAST(entry_id AS VARCHAR) AS ref_id, strftime(seen, '%Y-%m') AS period, h AS target FROM gone
UNION ALL
SELECT 'refs', CAST(ref_id AS VARCHAR), strftime(updated_at, '%Y-%m'), h FROM heads LEFT JOIN ids ON sid = h
WHERE h IS NOT NULL AND (NOT coalesce(live, false) OR to_timestamp(ts) AT TIME ZONE 'UTC' > updated_at)
UNION ALL
SELECT 'check_runs', CAST(run_id AS VARCHAR), strftime(ran_at, '%Y-%m'), h FROM runs LEFT JOIN ids ON ids.sid = h LEFT JOIN counts ON counts.sid = h
WHERE h IS NOT NULL AND (ids.sid IS NULL OR missing IS DISTINCT FROM coalesce(n, 0)))
"""

_REF_NAME = "regexp_replace(nfc_normalize(name), '^refs/', '')"
_P3 = f"""WITH
a AS (SELECT DISTINCT {_sql_hash("hash")} AS k, size, flags FROM chunks WHERE deleted_at IS NULL AND {_sql_hash("hash")} IS NOT NULL),
b AS (SELECT DISTINCT {_sql_hash("hash")} AS k, size, flags FROM remote_chunks WHERE {_sql_hash("hash")} IS NOT NULL),
c AS (SELECT DISTINCT ref_id AS k, {_REF_NAME} AS name, type, {_sql_hash("target")} AS target, nullif(symref, '') AS symref FROM refs WHERE ref_id IS NOT NULL),
d AS (SELECT DISTINCT ref_id AS k, {_REF_NAME} AS name, type, {_sql_hash("target")} AS target, nullif(symref, '') AS symref FROM remote_refs WHERE ref_id IS NOT NULL),
x AS (SELECT a.k AS l, b.k AS r, coalesce(a.k, b.k) AS k, a.size IS DISTINCT FROM b.size AS d1, a.flags IS DISTINCT FROM b.flags AS d2 FROM a FULL JOIN b ON a.k = b.k),
y AS (SELECT c.k AS l, d.k AS r, CAST(coalesce(c.k, d.k) AS VARCHAR) AS k, c.name IS DISTINCT FROM d.name AS d1, c.type IS DISTINCT FROM d.type AS d2,
      c.target IS DISTINCT FROM d.target AS d3, c.symref IS DISTINCT FROM d.symref AS d4 FROM c FULL JOIN d ON c.k = d.k)
SELECT DISTINCT 'chunks' AS copy_table, k AS row_key, unnest(CASE WHEN r IS NULL THEN ['missing_remote'] WHEN l IS NULL THEN ['missing_local']
  ELSE CASE WHEN d1 THEN ['size'] ELSE [] END || CASE WHEN d2 THEN ['flags'] ELSE [] END END) AS field FROM x
UNION ALL
SELECT DISTINCT 'refs', k, unnest(CASE WHEN r IS NULL THEN ['missing_remote'] WHEN l IS NULL THEN ['missing_local']
  ELSE CASE WHEN d1 THEN ['name'] ELSE [] END || CASE WHEN d2 THEN ['type'] ELSE [] END || CASE WHEN d3 THEN ['target'] ELSE [] END || CASE WHEN d4 THEN ['symref'] ELSE [] END END) FROM y
"""

_CLEAN_PATH = "nfc_normalize(array_to_string([x FOR x IN string_split(replace(path, '\\', '/'), '/') IF x <> '' AND x <> '.'], '/'))"
_P5 = f"""WITH {_SNAPSHOT_STATE},
pairs AS (SELECT DISTINCT {_sql_hash("snapshot_id")} AS sid, {_sql_hash("prev_id")} AS prev FROM snapshots
          WHERE {_sql_hash("prev_id")} IN (SELECT sid FROM ids)),
ranked AS (SELECT {_sql_hash("snapshot_id")} AS sid, {_CLEAN_PATH} AS path, {_sql_hash("file_hash")} AS fh, size, (mod_time // 1000000000 - CASE WHEN mod_time % 1000000000 < 0 THEN 1 ELSE 0 END) AS secs,
  row_number() OVER (PARTITION BY {_sql_hash("snapshot_id")}, {_CLEAN_PATH} ORDER BY entry_id DESC) AS rn FROM file_entries),
f AS (SELECT sid, path, fh, size, secs FROM ranked WHERE rn = 1),
n AS (SELECT p.sid, f.path, fh, size, secs FROM pairs p JOIN f ON f.sid = p.sid),
o AS (SELECT p.sid, f.path, fh, size, secs FROM pairs p JOIN f ON f.sid = p.prev)
SELECT coalesce(n.sid, o.sid) AS snapshot_id, coalesce(n.path, o.path) AS path,
  CASE WHEN o.sid IS NULL THEN 'added' WHEN n.sid IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN o ON n.sid = o.sid AND n.path = o.path
WHERE n.sid IS NULL OR o.sid IS NULL OR n.fh IS DISTINCT FROM o.fh OR n.size IS DISTINCT FROM o.size OR n.secs IS DISTINCT FROM o.secs
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p5_found": p5_found}
SQL = {
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_report": _P2 + "SELECT ref_table, period, count(*) AS n_references, count(DISTINCT target) AS n_targets FROM found GROUP BY 1, 2",
    "p3_found": _P3,
    "p5_found": _P5,
}
