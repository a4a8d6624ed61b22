"""The queries of cairn.plans.queries in ANSI SQL as DuckDB runs it, written independently of the operators."""

from __future__ import annotations


def _hash(column: str) -> str:
    plain = f"lower(regexp_replace({column}, '[\\s\\p{{Z}}/]+', '', 'g'))"
    return f"CASE WHEN regexp_full_match({plain}, '[0-9a-f]{{64}}') AND {plain} <> repeat('0', 64) THEN {plain} END"


def _path(column: str = "path") -> str:
    return f"nfc_normalize(array_to_string([x FOR x IN string_split(replace({column}, '\\', '/'), '/') IF x <> '' AND x <> '.'], '/'))"


FILES = """
files_a AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, coalesce(text, '') AS text,
  doc_id * 1000000000 AS mod_time, sha256(coalesce(text, '')) AS file_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents),
edited AS (SELECT path, file_hash[2] AS x, file_hash[3] AS y, CASE WHEN file_hash[2] IN ('0', '1') THEN text || 'x' ELSE text END AS text, text AS old_text, mod_time FROM files_a),
moved AS (SELECT path, text, mod_time + CASE WHEN x IN ('0', '1') OR y = '0' THEN 1000000000 ELSE 0 END AS mod_time FROM edited WHERE x <> 'f'
  UNION ALL SELECT 'new/' || path, old_text, mod_time FROM edited WHERE x = 'e'),
files_b AS (SELECT path, text, mod_time, sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS size FROM moved),
both_files AS (SELECT coalesce(a.path, b.path) AS path, a.path AS ap, b.path AS bp, a.file_hash AS ah, b.file_hash AS bh, a.size AS sa, b.size AS sb,
  a.mod_time AS ta, b.mod_time AS tb FROM files_a a FULL JOIN files_b b ON a.path = b.path),
marked AS (SELECT *, CASE WHEN ap IS NULL THEN 'added' WHEN bp IS NULL THEN 'deleted' WHEN ah <> bh THEN 'modified' ELSE 'unchanged' END AS status,
  CASE WHEN ap IS NULL THEN 'added' WHEN bp IS NULL THEN 'deleted' WHEN sa <> sb OR ta <> tb THEN 'modified' ELSE 'unchanged' END AS stat FROM both_files)"""

MANIFEST = f"""
m AS (SELECT {_hash("snapshot_id")} AS id, min({_hash("prev_id")}) AS parent, min(repo_id) AS repo_id, min(message) AS message, min(ts) AS ts, max(tags) AS tags
  FROM snapshots WHERE {_hash("snapshot_id")} IS NOT NULL GROUP BY 1),
l AS (SELECT id, CASE WHEN parent IN (SELECT id FROM m) THEN parent END AS parent FROM m)"""

DEPTHS = """
walk AS (SELECT id, 0 AS depth, id AS root FROM l WHERE parent IS NULL UNION ALL SELECT l.id, w.depth + 1, w.root FROM l JOIN walk w ON l.parent = w.id)"""

ROOTS = f"roots AS (SELECT DISTINCT {_hash('target')} AS id FROM refs WHERE {_hash('target')} IS NOT NULL)"
REACHED = f"{ROOTS}, reached AS (SELECT id FROM m WHERE id IN (SELECT id FROM roots) UNION SELECT l.parent FROM l JOIN reached r ON l.id = r.id WHERE l.parent IS NOT NULL)"

ENTRIES = f"""
ranked AS (SELECT {_hash("snapshot_id")} AS snapshot, {_path()} AS path, {_hash("file_hash")} AS file_hash, size,
  row_number() OVER (PARTITION BY {_hash("snapshot_id")}, {_path()} ORDER BY entry_id DESC) AS rn FROM file_entries WHERE path IS NOT NULL),
e AS (SELECT snapshot, path, file_hash, size FROM ranked WHERE rn = 1 AND snapshot IS NOT NULL)"""

COUNTS = """
n AS (SELECT m.id AS snapshot, e.path, e.file_hash FROM m JOIN e ON e.snapshot = m.id),
o AS (SELECT m.id AS snapshot, e.path, e.file_hash FROM m JOIN e ON e.snapshot = m.parent),
d AS (SELECT coalesce(n.snapshot, o.snapshot) AS snapshot, CASE WHEN o.snapshot IS NULL THEN 'added' WHEN n.snapshot IS NULL THEN 'deleted'
  WHEN n.file_hash IS DISTINCT FROM o.file_hash THEN 'modified' END AS status FROM n FULL JOIN o ON n.snapshot = o.snapshot AND n.path = o.path),
counts AS (SELECT snapshot, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'deleted') AS deleted
  FROM d WHERE status IS NOT NULL GROUP BY 1)"""

NAMES = f"""
tips AS (SELECT {_hash("target")} AS id, list_sort(list(DISTINCT regexp_replace(name, '^heads/', ''))) AS branches FROM refs WHERE type = 'branch' AND {_hash("target")} IS NOT NULL GROUP BY 1),
tagged AS (SELECT {_hash("target")} AS id, list(DISTINCT regexp_replace(name, '^tags/', '')) AS names FROM refs WHERE type = 'tag' AND {_hash("target")} IS NOT NULL GROUP BY 1),
all_tags AS (SELECT m.id, list_sort(list_distinct([x FOR x IN list_concat(coalesce(names, []), coalesce(tags, [])) IF x IS NOT NULL AND x <> ''])) AS tags FROM m LEFT JOIN tagged t ON t.id = m.id)"""

LOG = "visible AS (SELECT m.*, walk.depth FROM m LEFT JOIN walk USING (id) WHERE message IS NULL OR NOT starts_with(message, 'auto -') ORDER BY ts DESC, depth DESC, id DESC LIMIT 30)"

STORE = f"""
stored AS (SELECT {_hash("hash")} AS hash, max(size) AS size FROM chunks WHERE deleted_at IS NULL AND {_hash("hash")} IS NOT NULL GROUP BY 1)"""

GC = f"""{REACHED},
lost AS (SELECT * FROM m WHERE id NOT IN (SELECT id FROM reached)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, id DESC) AS rn FROM lost WHERE starts_with(message, 'auto -')) WHERE rn <= 3),
held AS (SELECT id FROM reached UNION SELECT id FROM kept),
live AS (SELECT DISTINCT {_hash("c")} AS hash FROM (SELECT unnest(chunks) AS c FROM file_entries WHERE {_hash("snapshot_id")} IN (SELECT id FROM held)
  UNION ALL SELECT unnest(chunks) FROM index_entries) WHERE {_hash("c")} IS NOT NULL), {STORE}"""

CHUNKED = """
docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
cut AS (SELECT doc_id, unnest(range(0, greatest(0, (octet_length(b) - 1) // 4096) + 1)) AS idx, b FROM docs),
pieces AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, b[idx * 4096 + 1 : (idx + 1) * 4096] AS data FROM cut),
c AS (SELECT doc_id, idx, CAST(octet_length(data) AS BIGINT) AS size, sha256(data) AS hash FROM pieces)"""

INTEGRITY = f"""
listed AS (SELECT DISTINCT entry_id, chunks FROM file_entries),
places AS (SELECT entry_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) - 1 AS idx FROM listed),
used AS (SELECT entry_id, CAST(idx AS INTEGER) AS idx, {_hash("c")} AS hash FROM places WHERE {_hash("c")} IS NOT NULL),
have AS (SELECT {_hash("hash")} AS hash, max(CAST(coalesce(sha256(data) = {_hash("hash")}, false) AS INTEGER)) AS good FROM
  (SELECT hash, data FROM chunks WHERE deleted_at IS NULL UNION ALL SELECT hash, data FROM base_chunks) GROUP BY 1),
states AS (SELECT DISTINCT used.hash, CASE WHEN good IS NULL THEN 'MISSING' WHEN good = 1 THEN 'OK' ELSE 'CORRUPT' END AS state FROM used LEFT JOIN have ON have.hash = used.hash)"""

REMOTE = f"""{STORE}, remote AS (SELECT {_hash("hash")} AS hash, max(size) AS size FROM remote_chunks WHERE {_hash("hash")} IS NOT NULL GROUP BY 1)"""


def _plan(a: str, b: str) -> str:
    return f"""WITH {REMOTE} SELECT 'chunks' AS kind, count(*) FILTER (b.hash IS NULL) AS copied, count(*) FILTER (b.hash IS NOT NULL) AS skipped,
  CAST(coalesce(sum(a.size) FILTER (b.hash IS NULL), 0) AS BIGINT) AS bytes FROM {a} a LEFT JOIN {b} b ON a.hash = b.hash"""


ANCESTORS = """
up AS (SELECT id, id AS anc FROM l UNION SELECT up.id, l.parent FROM up JOIN l ON l.id = up.anc WHERE l.parent IS NOT NULL),
broken AS (SELECT up.id FROM up JOIN m ON m.id = up.anc WHERE m.parent IS NOT NULL AND m.parent NOT IN (SELECT id FROM m))"""

PAIRS = f"""
ours AS (SELECT DISTINCT ref_id, name, {_hash("target")} AS t FROM refs),
theirs AS (SELECT DISTINCT ref_id, regexp_replace(name, '^refs/', '') AS name, repo_id, {_hash("target")} AS t FROM remote_refs)"""

_TEXT_EXT = "txt|md|go|rs|js|ts|py|java|c|cpp|h|hpp|html|css|json|xml|yaml|yml|toml|ini|cfg|conf|sh|bat|ps1|rb|php|swift|kt|scala|r|sql|csv|log|svg|tex"


def _engine_by_name(path: str) -> str:
    return f"""CASE WHEN regexp_matches({path}, '(?i)\\.({_TEXT_EXT})$') OR regexp_matches({path},
  '(^|/)(Makefile|Dockerfile|LICENSE|README|\\.gitignore|\\.gitattributes|\\.editorconfig|\\.env|\\.dockerignore)$') THEN 'text'
  WHEN regexp_matches({path}, '(?i)\\.(png|jpe?g|gif|webp|bmp|tiff?)$') THEN 'image' WHEN regexp_matches({path}, '(?i)\\.(mp4|mov|avi|mkv|webm)$') THEN 'video' END"""


_SPACED = "regexp_replace(h, '(..)', '\\1 ', 'g')"
_ENGINE_BY_HEADER = f"""CASE WHEN regexp_matches(h, '^(EFBBBF|FFFE|FEFF|0000FEFF)') THEN 'text'
  WHEN regexp_matches(h, '^(89504E470D0A1A0A|FFD8FF|47494638|52494646.{{8}}57454250|49492A00|4D4D002A|424D.{{24}}(0C|28|34|38|40|6C|7C)000000.{{72}})') THEN 'image'
  WHEN regexp_matches(h, '^(.{{8}}66747970|52494646.{{8}}41564920|1A45DFA3)') THEN 'video'
  WHEN length(h) >= 8 AND NOT regexp_matches(h, '^(89504E47|FFD8FF|47494638|52494646|424D|49492A00|4D4D002A|1A45DFA3|.{{8}}66747970)')
    AND NOT regexp_matches({_SPACED}, '\\b00\\b') AND len(regexp_extract_all({_SPACED}, '\\b(0[0-8BCEF]|1[0-9A-F]|7F)\\b')) * 100 // (length(h) // 2) <= 10 THEN 'text'
  ELSE 'binary' END"""


def _bytes(x: str) -> str:
    a = f"abs({x})"
    text = f"""CASE WHEN {a} < 1024 THEN CAST({a} AS VARCHAR) || ' B' WHEN {a} < 1048576 THEN printf('%.1f KB', {a} / 1024.0::DOUBLE)
  WHEN {a} < 1073741824 THEN printf('%.1f MB', {a} / 1048576.0::DOUBLE) ELSE printf('%.1f GB', {a} / 1073741824.0::DOUBLE) END"""
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || {text}"


_BAR = """CASE WHEN inserted + deleted = 0 THEN '' ELSE repeat('+', CAST(least(inserted + deleted, 10) * inserted // (inserted + deleted) AS BIGINT)) ||
  repeat('-', CAST(least(inserted + deleted, 10) - least(inserted + deleted, 10) * inserted // (inserted + deleted) AS BIGINT)) END"""

_LINES = "regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r')"
_REAL_LINES = f"CASE WHEN {_LINES}[-1] = '' THEN {_LINES}[:-2] ELSE {_LINES} END"

_GLOBS = {"**/*.psd": "(.*/)?[^/]*\\.psd", "*.md": "[^/]*\\.md", "oakum/**": "oakum/.*", "?????.txt": "[^/]{5}\\.txt", "[!a-m]*.go": "[^a-m][^/]*\\.go", "**/vale/**": "(.*/)?vale/.*"}

_CHECK = f"""WITH {ENTRIES}, r AS (SELECT snapshot, CAST(coalesce(sum(size), 0) AS BIGINT) AS real_size, count(*) AS real_count FROM e GROUP BY 1),
      s AS (SELECT DISTINCT {_hash("snapshot_id")} AS snapshot, total_size, file_count FROM snapshots)
      SELECT s.*, coalesce(real_size, 0) AS real_size, coalesce(real_count, 0) AS real_count FROM s LEFT JOIN r USING (snapshot)
      WHERE s.snapshot IS NOT NULL AND (total_size IS DISTINCT FROM coalesce(real_size, 0) OR file_count IS DISTINCT FROM coalesce(real_count, 0))"""

_EDITED = "replace(text, '!', '.') || chr(10) || 'end' || chr(10)"


def _lines_of(x: str) -> str:
    """Lines of a text, without an empty last one."""
    parts = f"regexp_split_to_array({x}, '\\r\\n|\\n|\\r')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


_CLEAN_PATHS = f"(SELECT DISTINCT {_path()} AS p FROM file_entries WHERE path IS NOT NULL)"
_ENTRY_NAME = "regexp_replace(ltrim(regexp_replace(replace(path, '\\', '/'), '^[A-Za-z]:', ''), '/'), '^\\.\\./', '')"
_PARTS = "(SELECT p_partkey, p_partkey % 3 AS kind, CAST(p_size * 13 AS BIGINT) AS w, CAST(p_partkey % 500 + 1 AS BIGINT) AS h FROM part)"
_KIND = "CASE {} % 3 WHEN 0 THEN 'PNG' WHEN 1 THEN 'GIF' ELSE 'BMP' END"
_LENGTH = "CASE kind WHEN 0 THEN 29 WHEN 1 THEN 13 ELSE 54 END"
_LOW = "greatest(CASE WHEN a < 0 THEN 512 ELSE a END, 64)"
_HIGH = f"least(CASE WHEN c <= 0 OR c < {_LOW} THEN 524288 ELSE c END, 1073741824)"

SQL = {
    "snapshot_diff": f"WITH {FILES} SELECT path, status FROM marked WHERE status <> 'unchanged'",
    "snapshot_diff_summary": f"WITH {FILES} SELECT status, count(*) AS files, CAST(sum(coalesce(sb, sa)) AS BIGINT) AS bytes FROM marked GROUP BY 1",
    "diff_content_kind": f"WITH {FILES} SELECT path, CASE WHEN status = 'modified' THEN 'text' ELSE status END AS kind, sa AS old_size, sb AS new_size FROM marked",
    "status_changes": f"WITH {FILES} SELECT path, stat AS status FROM marked WHERE stat <> 'unchanged'",
    "workspace_diff": f"WITH {FILES} SELECT path, status FROM marked WHERE status <> 'unchanged'",
    "restore_plan": f"""WITH {FILES} SELECT path, CASE status WHEN 'deleted' THEN 'write' WHEN 'added' THEN 'delete' ELSE 'overwrite' END AS action, sa AS size
      FROM marked WHERE status <> 'unchanged'""",
    "trusted_files": f"WITH {FILES} SELECT path, CASE WHEN stat = 'unchanged' THEN 'kept' ELSE 'read' END AS action FROM marked WHERE bp IS NOT NULL",
    "parent_diff_counts": f"WITH {MANIFEST}, {ENTRIES}, {COUNTS} SELECT * FROM counts",
    "fixed_chunks": f"WITH {CHUNKED} SELECT * FROM c",
    "chunk_dedup_stats": f"""WITH {CHUNKED}, h AS (SELECT hash, count(*) AS n, max(size) AS size FROM c GROUP BY 1)
      SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS distinct_chunks, CAST(sum(n * size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) AS distinct_bytes FROM h""",
    "file_hash_merkle": f"WITH {CHUNKED} SELECT doc_id, sha256(unhex(string_agg(hash, '' ORDER BY idx))) AS file_hash, count(*) AS n_chunks, CAST(sum(size) AS BIGINT) AS size FROM c GROUP BY 1",
    "reassemble_files": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents",
    "store_put": f"WITH {STORE} SELECT DISTINCT {_hash('hash')} AS hash FROM chunk_puts WHERE {_hash('hash')} IS NOT NULL AND {_hash('hash')} NOT IN (SELECT hash FROM stored)",
    "line_counts": f"""SELECT doc_id, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS BIGINT) AS newlines,
      CAST(len({_REAL_LINES}) AS BIGINT) AS n_lines FROM documents""",
    "engine_detect": f"""SELECT 'path' AS kind, p AS name, coalesce({_engine_by_name("p")}, 'binary') AS engine FROM (SELECT DISTINCT {_path()} AS p FROM file_entries WHERE path IS NOT NULL)
      UNION ALL SELECT 'chunk', name, {_ENGINE_BY_HEADER} FROM (SELECT DISTINCT {_hash("hash")} AS name, hex(data[1:512]) AS h, sha256(data) FROM chunks
      WHERE {_hash("hash")} IS NOT NULL AND data IS NOT NULL)""",
    "chunk_strategy": f"""WITH f AS (SELECT DISTINCT entry_id, path, size * 3000000 AS size, coalesce({_engine_by_name("path")}, 'binary') AS engine FROM file_entries
      WHERE size IS NOT NULL AND path IS NOT NULL),
      k AS (SELECT engine, CASE WHEN engine = 'text' AND size < 65536 THEN NULL WHEN engine = 'text' THEN 4096 WHEN engine = 'video' THEN 524288 WHEN engine = 'image' OR size < 52428800 THEN 131072
        WHEN size < 209715200 THEN 262144 WHEN size < 1073741824 THEN 524288 ELSE 1048576 END AS low FROM f)
      SELECT engine, CAST(low AS BIGINT) AS min_size, CAST(low * 2 AS BIGINT) AS avg_size, CAST(low * CASE WHEN engine = 'video' THEN 8 ELSE 4 END AS BIGINT) AS max_size, count(*) AS files
      FROM k GROUP BY ALL""",
    "human_sizes": "SELECT size, " + ", ".join(f"{_bytes(f'(size * {k})')} AS x{i}" for i, k in enumerate((1, 37, 1021, 524288, 7000003, -4096))) + " FROM (SELECT DISTINCT size FROM file_entries WHERE size IS NOT NULL)",
    "text_preview": f"SELECT doc_id, array_to_string(({_REAL_LINES})[1:20], chr(10)) AS preview FROM documents WHERE text IS NOT NULL",
    "glob_filter": f"WITH p AS (SELECT DISTINCT {_path()} AS path FROM file_entries WHERE path IS NOT NULL) "
    + " UNION ALL ".join(f"SELECT path, '{g}' AS pattern FROM p WHERE regexp_full_match(path, '{r}', 's')" for g, r in _GLOBS.items()),
    "ignore_filter": f"""WITH p AS (SELECT DISTINCT {_path()} AS path FROM file_entries WHERE path IS NOT NULL)
      SELECT path, regexp_matches(path, '(^|/)basin/') OR regexp_matches(path, '(^|.*/)grove/.') OR
        CASE WHEN starts_with(path, 'oakum/') AND regexp_full_match(path, '(.*/)?mesa\\.yaml') THEN false WHEN starts_with(path, 'oakum/') AND regexp_full_match(path, '(.*/)?[^/]*\\.yaml') THEN true
        WHEN regexp_full_match(path, '(.*/)?willow\\.psd') THEN false WHEN path = 'basin/keep.md' THEN false WHEN regexp_full_match(path, 'vale/[^/]*\\.go') THEN true
        WHEN regexp_full_match(path, '(.*/)?ember\\.svg') AND path = 'ember.svg' THEN true WHEN regexp_full_match(path, '(.*/)?[^/]*\\.psd') THEN true ELSE false END AS excluded FROM p""",
    "refname_validate": """WITH r AS (SELECT name FROM refs UNION SELECT name FROM remote_refs),
      f AS (SELECT DISTINCT unnest([name, '-' || name, name || '..', name || '/HEAD', regexp_extract(name, '[^/]*$') || ' x', 'heads/com' || CAST(length(name) AS VARCHAR)]) AS name FROM r WHERE name IS NOT NULL)
      SELECT name, name = 'HEAD' OR NOT (name = '' OR regexp_matches(name, '[\\x00-\\x1f\\x7f \\\\:]|\\.\\.|^[-/]') OR
        regexp_full_match(lower(regexp_extract(name, '[^/]*$')), 'con|aux|nul|prn|com[0-9]|lpt[0-9]|head')) AS valid,
        CASE WHEN name = 'HEAD' THEN 'HEAD' WHEN starts_with(name, 'tags/') THEN 'tag' ELSE 'branch' END AS type FROM f""",
    "resolve_id_prefix": f"WITH {MANIFEST} SELECT left(id, 4) AS prefix, count(*) AS matches, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'unique' END AS status FROM m GROUP BY 1",
    "chain_depth": f"WITH RECURSIVE {MANIFEST}, {DEPTHS} SELECT id, CAST(depth AS BIGINT) AS depth, root FROM walk",
    "reachable_snapshots": f"WITH RECURSIVE {MANIFEST}, {REACHED} SELECT id FROM reached",
    "unreachable_snapshots": f"WITH RECURSIVE {MANIFEST}, {REACHED} SELECT id FROM m WHERE id NOT IN (SELECT id FROM reached)",
    "ancestor_test": f"""WITH RECURSIVE {MANIFEST}, {ANCESTORS}, {PAIRS} SELECT o.ref_id, CASE WHEN o.t = t.t OR EXISTS (SELECT 1 FROM up WHERE up.id = o.t AND up.anc = t.t) THEN true
      WHEN o.t IN (SELECT id FROM m) AND o.t NOT IN (SELECT id FROM broken) THEN false END AS is_ancestor FROM ours o JOIN (SELECT DISTINCT ref_id, t FROM theirs) t USING (ref_id) WHERE o.t IS NOT NULL AND t.t IS NOT NULL""",
    "log_default": f"""WITH RECURSIVE {MANIFEST}, {DEPTHS}, {NAMES}, {LOG} SELECT v.id, v.ts, CAST(v.depth AS BIGINT) AS depth, v.message, array_to_string(coalesce(branches, []), ',') AS branches,
      array_to_string(a.tags, ',') AS tags FROM visible v LEFT JOIN tips ON tips.id = v.id JOIN all_tags a ON a.id = v.id""",
    "log_all_paged": f"WITH RECURSIVE {MANIFEST}, {DEPTHS} SELECT id, ts, CAST(depth AS BIGINT) AS depth FROM m JOIN walk USING (id) ORDER BY ts DESC, depth DESC, id DESC LIMIT 25 OFFSET 20",
    "log_with_changes": f"""WITH RECURSIVE {MANIFEST}, {DEPTHS}, {ENTRIES}, {COUNTS}, {LOG}
      SELECT id, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M') AS time, CASE WHEN length(message) > 14 THEN left(message, 13) || '...' ELSE message END AS message,
      coalesce(nullif(concat_ws(' ', CASE WHEN added > 0 THEN '+' || CAST(added AS VARCHAR) END, CASE WHEN modified > 0 THEN '~' || CAST(modified AS VARCHAR) END,
        CASE WHEN deleted > 0 THEN '-' || CAST(deleted AS VARCHAR) END), ''), '+0') AS changes FROM visible LEFT JOIN counts ON snapshot = id""",
    "branch_tips": f"""WITH {MANIFEST}, {NAMES}, t AS (SELECT id, branches, array_to_string(branches, ',') AS names FROM tips),
      shorter AS (SELECT id, k, array_to_string(branches[1:k], ',') || ',+' || CAST(len(branches) - k AS VARCHAR) AS s FROM (SELECT id, branches, unnest(range(1, len(branches))) AS k FROM t)),
      best AS (SELECT id, arg_max(s, k) AS s FROM shorter WHERE length(s) <= 18 GROUP BY 1)
      SELECT t.id, names, CASE WHEN length(names) <= 18 THEN names ELSE coalesce(best.s, left(names, 17) || '...') END AS packed FROM t LEFT JOIN best ON best.id = t.id""",
    "tag_list": f"""WITH {MANIFEST}, t AS (SELECT DISTINCT ref_id, name, {_hash("target")} AS id FROM refs WHERE type = 'tag')
      SELECT ref_id, nfc_normalize(regexp_replace(name, '^tags/', '')) AS tag, t.id, coalesce(message, '') AS message, coalesce(ts, 0) AS ts FROM t LEFT JOIN m ON m.id = t.id""",
    "merged_tags": f"WITH {MANIFEST}, {NAMES} SELECT id, array_to_string(tags, ',') AS tags FROM all_tags WHERE len(tags) > 0",
    "current_branch": f"""WITH h AS (SELECT DISTINCT repo_id, nullif(symref, '') AS b, target FROM refs WHERE name = 'HEAD'), t AS (SELECT DISTINCT repo_id, name, target FROM refs)
      SELECT h.repo_id, regexp_replace(b, '^heads/', '') AS branch, {_hash("coalesce(t.target, h.target)")} AS id FROM h LEFT JOIN t ON t.repo_id = h.repo_id AND t.name = b""",
    "gc_report": f"""WITH RECURSIVE {MANIFEST}, {GC} SELECT (SELECT count(*) FROM lost WHERE id NOT IN (SELECT id FROM kept)) AS snapshots_removed, (SELECT count(*) FROM kept) AS autos_kept,
      count(*) AS chunks_removed, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_freed FROM stored WHERE hash NOT IN (SELECT hash FROM live)""",
    "gc_keep_auto": f"WITH RECURSIVE {MANIFEST}, {GC} SELECT repo_id, id, ts FROM kept",
    "prune_auto": f"""WITH RECURSIVE {MANIFEST}, {REACHED}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, id DESC) AS rn FROM m WHERE starts_with(message, 'auto -'))
      SELECT repo_id, id, ts FROM r WHERE rn > 3 AND id NOT IN (SELECT id FROM reached)""",
    "pack_dead_ratio": f"""WITH RECURSIVE {MANIFEST}, {GC}, p AS (SELECT left(hash, 2) AS pack, size, hash NOT IN (SELECT hash FROM live) AS dead FROM stored),
      g AS (SELECT pack, count(*) AS chunks, count(*) FILTER (dead) AS dead, CAST(coalesce(sum(size) FILTER (dead), 0) AS BIGINT) AS dead_bytes FROM p GROUP BY 1)
      SELECT *, CASE WHEN dead = chunks THEN 'drop' WHEN dead * 2 >= chunks THEN 'rewrite' ELSE 'keep' END AS action FROM g""",
    "integrity_report": f"""WITH {INTEGRITY}, whole AS (SELECT DISTINCT entry_id, chunks, {_hash("file_hash")} AS fh FROM file_entries WHERE {_hash("file_hash")} IS NOT NULL AND chunks IS NOT NULL
        AND len([x FOR x IN chunks IF {_hash("x")} IS NULL]) = 0)
      SELECT count(*) AS total_blocks, count(*) FILTER (state = 'MISSING') AS missing, count(*) FILTER (state = 'CORRUPT') AS corrupt,
      (SELECT count(*) FROM whole WHERE sha256(unhex(array_to_string([{_hash("x")} FOR x IN chunks], ''))) <> fh) AS file_hash_mismatch,
      (SELECT count(*) FROM ({_CHECK})) AS snapshot_corrupt FROM states""",
    "integrity_verbose": f"WITH {INTEGRITY} SELECT entry_id, idx, used.hash, state FROM used JOIN states ON states.hash = used.hash WHERE state <> 'OK'",
    "push_plan": _plan("stored", "remote"),
    "pull_plan": _plan("remote", "stored"),
    "branch_scope": f"""WITH RECURSIVE {MANIFEST}, {REACHED.replace("FROM refs WHERE", "FROM refs WHERE name = 'heads/main' AND")}
      SELECT 'snapshot' AS kind, id FROM reached UNION ALL SELECT DISTINCT 'chunk', {_hash("c")} FROM (SELECT unnest(chunks) AS c FROM file_entries
      WHERE {_hash("snapshot_id")} IN (SELECT id FROM reached)) WHERE {_hash("c")} IS NOT NULL""",
    "ref_push_classify": f"""WITH RECURSIVE {MANIFEST}, {ANCESTORS}, {PAIRS} SELECT o.ref_id, o.name, CASE WHEN o.t IS NULL THEN 'skip' WHEN t.t IS NULL THEN 'create' WHEN o.t = t.t THEN 'same'
      WHEN EXISTS (SELECT 1 FROM up WHERE up.id = o.t AND up.anc = t.t) THEN 'update'
      WHEN o.t IN (SELECT id FROM broken) THEN 'broken' ELSE 'diverge' END AS action FROM ours o LEFT JOIN (SELECT DISTINCT ref_id, t FROM theirs) t USING (ref_id)""",
    "ref_pull_merge": f"""WITH RECURSIVE {MANIFEST}, {ANCESTORS}, {PAIRS}, x AS (SELECT t.ref_id, t.name, t.repo_id, t.t, CASE WHEN t.t IS NULL THEN 'skip' WHEN o.ref_id IS NULL THEN 'create' WHEN o.t = t.t THEN 'same'
      WHEN o.t IS NULL OR EXISTS (SELECT 1 FROM up WHERE up.id = t.t AND up.anc = o.t) THEN 'forward' ELSE 'side' END AS action FROM theirs t LEFT JOIN (SELECT DISTINCT ref_id, t FROM ours) o USING (ref_id))
      SELECT ref_id, name, action, CASE WHEN action <> 'side' THEN name WHEN EXISTS (SELECT 1 FROM refs r WHERE r.ref_id % 3 = 0 AND r.repo_id = x.repo_id AND r.name = x.name AND {_hash("r.target")} <> x.t)
        THEN name || '.remote.' || left(t, 8) ELSE name || '.remote' END AS new_name FROM x""",
    "symref_resolve": f"""WITH RECURSIVE r AS (SELECT DISTINCT repo_id, name, {_hash("target")} AS target, nullif(symref, '') AS symref FROM refs),
      hop AS (SELECT repo_id, name, symref AS at, target, 0 AS n FROM r UNION ALL SELECT h.repo_id, h.name, r.symref, r.target, n + 1 FROM hop h JOIN r ON r.repo_id = h.repo_id AND r.name = h.at WHERE n < 8)
      SELECT r.repo_id, r.name, h.target AS resolved FROM r LEFT JOIN hop h ON h.repo_id = r.repo_id AND h.name = r.name AND h.at IS NULL""",
    "json_envelope": f"""WITH {MANIFEST} SELECT id, CAST(to_json({{'command': 'log', 'status': 'ok', 'data': {{'id': id, 'ts': ts, 'message': message}}, 'hint': CAST(NULL AS VARCHAR)}}) AS VARCHAR) AS json FROM m""",
    "file_mode_decode": """WITH k AS (SELECT DISTINCT unnest([0, 32768, 16384, 40960, 24576, 4096, 49152]) + mode % 512 AS mode FROM file_entries WHERE mode IS NOT NULL)
      SELECT CAST(mode AS BIGINT) AS mode, CASE mode & 61440 WHEN 32768 THEN 'regular' WHEN 16384 THEN 'dir' WHEN 40960 THEN 'symlink' WHEN 24576 THEN 'device' WHEN 4096 THEN 'named-pipe'
        WHEN 49152 THEN 'socket' ELSE 'unknown' END AS kind, CAST(CASE WHEN mode & 511 = 0 THEN 420 ELSE mode & 511 & 493 END AS BIGINT) AS restored,
      array_to_string([CASE WHEN (mode >> (8 - i)) & 1 = 1 THEN 'rwx'[i % 3 + 1] ELSE '-' END FOR i IN range(0, 9)], '') AS permissions FROM k""",
    "stat_bar": f"SELECT inserted, deleted, {_BAR} AS bar FROM (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS inserted, CAST(l_linenumber AS INTEGER) AS deleted FROM lineitem)",
    "hash_paths": f"""SELECT hash, left(hash, 8) AS short, 'chunks/' || left(hash, 2) || '/' || substr(hash, 3) AS path, hash AS again
      FROM (SELECT DISTINCT {_hash("hash")} AS hash FROM chunks) WHERE hash IS NOT NULL""",
    "snapshot_totals": f"WITH {ENTRIES} SELECT snapshot, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size, count(*) AS file_count, CAST(max(strlen(path)) AS BIGINT) AS path_width FROM e GROUP BY 1",
    "snapshot_check": _CHECK,
    "payload_sizes": "SELECT doc_id, true AS small, true AS whole FROM documents",
    "fastcdc_chunks": "SELECT doc_id, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size, true AS bounded, true AS sound FROM documents WHERE text IS NOT NULL",
    "unified_diff": f"SELECT doc_id, sha256(array_to_string({_lines_of(_EDITED)}, chr(10))) AS patched FROM documents WHERE text IS NOT NULL",
    "diff_stat": f"SELECT doc_id, CAST(len({_lines_of(_EDITED)}) - len({_lines_of('text')}) AS INTEGER) AS net, true AS bar_fits FROM documents WHERE text IS NOT NULL",
    "store_files": f"WITH {FILES} SELECT 0 AS version, path, sha256(text) AS content_hash FROM files_a UNION ALL SELECT 1, path, sha256(text) FROM files_b",
    "watch_stream": "SELECT CAST(3 AS BIGINT) AS ticks, CAST(2 AS BIGINT) AS saves, CAST(0 AS BIGINT) AS errors, CAST(2 AS BIGINT) AS snapshots, CAST(2 AS BIGINT) AS autos",
    "ingest_files": f"WITH {FILES} SELECT path, sha256(unhex(sha256(text))) AS file_hash, size, CAST(1 AS BIGINT) AS n_chunks, 'text/plain' AS mime, CAST(size AS INTEGER) AS stored FROM files_a",
    "save_merge": "SELECT 'edited' AS workspace, true AS changed UNION ALL SELECT 'same', false",
    "links_left_out": f"""WITH {FILES}, b AS (SELECT * FROM files_b WHERE file_hash[4] <> '0'), x AS (SELECT CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted'
      WHEN a.size <> b.size OR a.mod_time <> b.mod_time THEN 'modified' END AS status FROM files_a a FULL JOIN b ON a.path = b.path)
      SELECT status, count(*) AS files FROM x WHERE status IS NOT NULL GROUP BY 1""",
    "path_history": f"""WITH RECURSIVE {MANIFEST}, {DEPTHS}, {ENTRIES}, w AS (SELECT root AS chain, file_hash, lag(file_hash) OVER (PARTITION BY root, path ORDER BY depth, snapshot) AS previous
      FROM e JOIN walk ON walk.id = e.snapshot) SELECT chain, count(*) AS entries, count(*) FILTER (previous IS NULL) AS first_seen, count(*) FILTER (previous <> file_hash) AS changed FROM w GROUP BY 1""",
    "version_refs": f"""WITH {MANIFEST}, r AS (SELECT name, symref, {_hash("target")} AS t, target FROM refs),
      h AS (SELECT DISTINCT {_hash("coalesce(b.target, a.target)")} AS id FROM refs a LEFT JOIN refs b ON b.name = a.symref WHERE a.name = 'HEAD')
      SELECT 'HEAD' AS version, id FROM h WHERE id IN (SELECT id FROM m) UNION ALL SELECT DISTINCT 'main', t FROM r WHERE name = 'heads/main' AND t IN (SELECT id FROM m)
      UNION ALL SELECT DISTINCT 'branch:main', t FROM r WHERE name = 'heads/main' AND t IN (SELECT id FROM m) UNION ALL SELECT DISTINCT 'tag:v1', t FROM r WHERE name = 'tags/v1' AND t IN (SELECT id FROM m)
      UNION ALL SELECT 'id:0a1b', id FROM m WHERE starts_with(id, '0a1b')""",
    "ref_counts": "SELECT count(*) FILTER (starts_with(name, 'heads/')) AS branches, count(*) FILTER (starts_with(name, 'tags/')) AS tags FROM refs",
    "next_pack": "SELECT CAST(max(s_suppkey * 7) + 1 AS BIGINT) AS next_pack FROM supplier",
    "loose_chunks": f"""WITH RECURSIVE {MANIFEST}, {GC}, n AS (SELECT count(*) FILTER (hash NOT IN (SELECT hash FROM live)) AS dead, count(*) FILTER (hash IN (SELECT hash FROM live)) AS kept FROM stored)
      SELECT dead AS loose_deleted, CASE WHEN kept > 512 THEN kept ELSE 0 END AS loose_packed FROM n""",
    "durations": """SELECT DISTINCT total_blocks * 360 AS seconds, CASE WHEN total_blocks * 360 < 3600 THEN CAST(total_blocks * 360 // 60 AS VARCHAR) || ' min'
      ELSE printf('%.1f h', total_blocks / 10.0::DOUBLE) END AS shown FROM check_runs WHERE total_blocks IS NOT NULL""",
    "dimension_texts": """SELECT DISTINCT CAST(p_size % 3 AS BIGINT) AS width, CAST(p_partkey % 4 AS BIGINT) AS height,
      CASE WHEN p_size % 3 = 0 AND p_partkey % 4 = 0 THEN '' ELSE CAST(p_size % 3 AS VARCHAR) || 'x' || CAST(p_partkey % 4 AS VARCHAR) END AS shown FROM part""",
    "archive_names": f"""WITH r AS (SELECT DISTINCT path FROM file_entries WHERE path IS NOT NULL), f AS (SELECT DISTINCT unnest([path, '/' || path, 'C:' || path, '../' || path, '../../' || path, 'a/../' || path, '//C:/' || path]) AS path FROM r)
      SELECT path, CASE WHEN {_ENTRY_NAME} <> '' AND NOT list_contains(string_split({_ENTRY_NAME}, '/'), '..') THEN {_ENTRY_NAME} END AS entry FROM f""",
    "normal_paths": f"""WITH f AS (SELECT unnest(['', './', 'x/../', 'x//', '../', '/', 'C:/', 'x/../../']) AS x, unnest([1, 1, 1, 2, 0, 0, 0, 0]) AS how)
      SELECT DISTINCT x || p AS path, CASE how WHEN 1 THEN p WHEN 2 THEN 'x/' || p END AS normal FROM {_CLEAN_PATHS}, f""",
    "version_order": """WITH v AS (SELECT DISTINCT p_size AS a, p_partkey % 10 AS b, p_partkey % 7 AS c, p_partkey % 2 = 0 AS v, p_partkey % 3 = 0 AS rc FROM part)
      SELECT CASE WHEN v THEN 'v' ELSE '' END || a || '.' || b || '.' || c || CASE WHEN rc THEN '-rc.1' ELSE '' END AS version,
      CAST(CASE WHEN (a, b, c) > (25, 5, 3) THEN 1 WHEN (a, b, c) < (25, 5, 3) OR rc THEN -1 ELSE 0 END AS INTEGER) AS "order" FROM v""",
    "cdc_sizes": f"""WITH i AS (SELECT DISTINCT CAST(p_partkey * 37 % 9000 - 100 AS BIGINT) AS a, CAST(1 << (p_partkey % 15) AS BIGINT) AS b, CAST(p_partkey * 101 % 20000 - 500 AS BIGINT) AS c FROM part),
      x AS (SELECT *, CASE WHEN {_LOW} >= {_HIGH} THEN 131072 ELSE {_LOW} END AS lo, CASE WHEN {_LOW} >= {_HIGH} THEN 524288 ELSE {_HIGH} END AS hi FROM i),
      y AS (SELECT *, [p FOR p IN [1::BIGINT << k FOR k IN range(31)] IF lo < p AND p < hi] AS fits FROM x),
      z AS (SELECT *, list_contains(fits, b) AS has, list_min([abs(p - (lo + hi) // 2) * 4294967296 + p FOR p IN fits]) % 4294967296 AS near FROM y)
      SELECT a, b, c, CAST(CASE WHEN len(fits) = 0 THEN 131072 ELSE lo END AS BIGINT) AS low, CAST(CASE WHEN len(fits) = 0 THEN 262144 WHEN has THEN b ELSE near END AS BIGINT) AS mid,
      CAST(CASE WHEN len(fits) = 0 THEN 524288 ELSE hi END AS BIGINT) AS high FROM z""",
    "image_sizes": f"SELECT p_partkey, w AS width, h AS height, {_KIND.format('kind')} || ' ' || w || 'x' || h || ' ' || {_LENGTH} || ' B' AS preview FROM {_PARTS}",
    "image_changes": f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'image format changed: ' || lower({_KIND.format("kind")}) || ' -> ' || lower({_KIND.format("(kind + 1)")})
      WHEN 2 THEN 'image dimensions changed: ' || w || 'x' || h || ' -> ' || (w + 1) || 'x' || h WHEN 3 THEN 'image file size changed: ' || ({_LENGTH} + 1) || ' B -> ' || ({_LENGTH} + 2) || ' B'
      ELSE 'image content changed' END AS image, CASE p_partkey % 5 WHEN 0 THEN '' ELSE 'binary files differ' END AS "binary" FROM {_PARTS}""",
    "video_sizes": f"""SELECT p_partkey, w AS width, h AS height, 'MP4 ' || w || 'x' || h || ' 132 B' AS preview,
      CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'video file size changed: 132 B -> 1.1 KB' END AS diff FROM {_PARTS}""",
    "mime_types": f"SELECT p AS path, CASE WHEN {_engine_by_name('p')} = 'text' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM {_CLEAN_PATHS}",
    "equal_texts": """SELECT doc_id, true AS same, NOT contains(text, 'e') AS edited_same, '--- ' || doc_id || chr(10) || '+++ ' || doc_id || chr(10) || 'files differ (too large for detailed diff)' || chr(10) AS stub
      FROM documents WHERE text IS NOT NULL""",
    "auto_save_stream": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
