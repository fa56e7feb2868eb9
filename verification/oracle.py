"""DuckDB counterparts of the registered queries, written independently of the Spark plans."""

import re

PARTS: dict[str, str] = {}
SQL: dict[str, str] = {}

_RUN_COLUMNS = (
    "file_name, full_path, size_bytes, date_modified_utc, date_created_utc"
)


def _root(path: str) -> str:
    return f"regexp_extract({path}, '^[a-z0-9]+://[^/]*/')"


def _leaf(path: str) -> str:
    return (
        f"CASE WHEN {path} = {_root(path)} THEN {path} "
        f"ELSE string_split(rtrim({path}, '/'), '/')[-1] END"
    )


def _parent(path: str) -> str:
    return (
        f"CASE WHEN {path} = {_root(path)} THEN NULL "
        f"WHEN len(string_split({path}, '/')) = 4 THEN {_root(path)} "
        f"ELSE regexp_replace({path}, '/[^/]*$', '') END"
    )


def _ancestors(path: str) -> str:
    parts = f"string_split({path}, '/')"
    return (
        f"list_transform(generate_series(3, len({parts}) - 1), lambda i: "
        f"array_to_string({parts}[1:i], '/') || CASE WHEN i = 3 THEN '/' ELSE '' END)"
    )


def _beneath(path: str, folder: str) -> str:
    return (
        f"{path} <> {folder} AND starts_with({path}, "
        f"CASE WHEN {folder} LIKE '%/' THEN {folder} ELSE {folder} || '/' END)"
    )


def _le64(n: str) -> str:
    big = f"lpad(hex({n}), 16, '0')"
    return " || ".join(f"substr({big}, {at}, 2)" for at in range(15, 0, -2))


def _bytes(n: str) -> str:
    cases = "".join(
        f"WHEN {n} >= {1024**power} THEN "
        f"regexp_replace(CAST(round({n} / {1024**power}.0::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' {unit}' "
        for power, unit in [(5, "PB"), (4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")]
    )
    return f"CASE {cases} ELSE {n} || ' B' END"


def _quote(text: str) -> str:
    for plain, escaped in [("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"),
                           ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")]:
        text = f"replace({text}, {plain}, {escaped})"
    return f"'\"' || {text} || '\"'"


def _iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


# Inputs

PARTS["doc_flags"] = """
SELECT doc_id, max(toxic) = 1 AS unreadable, min(quality) = 0 AS is_link FROM labels GROUP BY doc_id"""

PARTS["inv_docs"] = """
SELECT d.doc_id, source, lang, 's3://' || source || '/' AS drive,
  's3://' || source || '/' || lang || '/b' || (d.doc_id // 20 % 5) || '/doc_' || d.doc_id || '.txt' AS full_path,
  'doc_' || d.doc_id || '.txt' AS file_name,
  CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS raw_hash,
  TIMESTAMP '2023-01-01 00:00:00' + to_minutes(d.doc_id) AS date_modified_utc,
  TIMESTAMP '2022-01-01 00:00:00' + to_minutes(n_chars) AS date_created_utc,
  coalesce(unreadable, false) AS unreadable, coalesce(is_link, false) AS is_link
FROM documents d LEFT JOIN doc_flags f ON f.doc_id = d.doc_id"""

PARTS["scans_docs"] = """
SELECT 'r-' || source || '-' || k AS scan_run_id, 's3://' || source || '/' AS drive, status,
  TIMESTAMP '2024-01-01 00:00:00' AS started_at_utc,
  CASE WHEN k = 3 THEN NULL WHEN k = 0 AND source <> 'src7' THEN TIMESTAMP '2024-01-01 01:00:00'
       WHEN k = 2 THEN TIMESTAMP '2024-01-03 01:30:15' ELSE TIMESTAMP '2024-01-02 01:00:00' END
  AS completed_at_utc
FROM (SELECT DISTINCT source FROM documents) s,
     (VALUES (0, 'Completed'), (1, 'Completed'), (2, 'Canceled'), (3, 'Running')) AS r(k, status)
UNION ALL SELECT 'r-backup-1', 's3://backup/', 'Completed', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-02 01:00:00'
UNION ALL SELECT 'r-nodrive', NULL, 'Completed', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-05 01:00:00'"""

PARTS["entries_files"] = f"""
SELECT 'r-' || source || '-0' AS scan_run_id, {_RUN_COLUMNS}, raw_hash AS content_hash, NULL AS scan_error FROM inv_docs
UNION ALL SELECT 'r-' || source || '-1', {_RUN_COLUMNS}, CASE WHEN NOT unreadable THEN raw_hash END,
  CASE WHEN unreadable THEN 'IOException: file locked' END FROM inv_docs
UNION ALL SELECT 'r-' || source || '-2', {_RUN_COLUMNS}, NULL, NULL FROM inv_docs
UNION ALL SELECT 'r-backup-1', file_name, 's3://backup/old/' || substr(full_path, 6), size_bytes,
  date_modified_utc, date_created_utc, raw_hash, NULL FROM inv_docs
UNION ALL SELECT 'r-ghost', {_leaf("url")}, url, CAST(octet_length(encode(html)) AS BIGINT),
  TIMESTAMP '2023-06-01 00:00:00' + to_minutes(page_id), NULL, sha256(html), NULL FROM pages"""

PARTS["skips_docs"] = """
SELECT DISTINCT 's3://' || source || '/' || lang || '/denied' AS full_path,
  'UnauthorizedAccessException: access denied' AS reason, 'r-' || source || '-' || k AS scan_run_id
FROM documents, (VALUES (0), (1)) AS r(k) WHERE lang <> 'en'"""

PARTS["line_files"] = """
SELECT 'r-lines' AS scan_run_id, 'l' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS file_name,
  's3://' || lower(l_returnflag) || '/' || year(l_shipdate) || '/' || month(l_shipdate) || '/o' || l_orderkey
    || '/l' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS full_path,
  CAST(l_quantity AS BIGINT) * 1024 AS size_bytes, l_shipdate AS date_modified_utc,
  CAST(NULL AS TIMESTAMP) AS date_created_utc,
  sha256(concat_ws('|', l_partkey, CAST(l_quantity AS BIGINT))) AS content_hash FROM lineitem"""

PARTS["event_scans"] = """
SELECT 'e' || event_id AS scan_run_id,
  CASE WHEN user_id >= 145 THEN NULL ELSE 's3://u' || user_id || '/' END AS drive,
  CASE event_type WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Running' WHEN 'click' THEN 'Canceled'
       ELSE 'Completed' END AS status,
  ts AS started_at_utc, CASE WHEN event_type <> 'signup' THEN ts END AS completed_at_utc FROM events"""

# Folders


def _leaves(files: str) -> str:
    """The leaves of every folder's fingerprint, whether all its files are hashed or not."""
    return f"""
SELECT scan_run_id, folder, substr(content_hash, 1, 4) AS leaf,
  sha256(string_agg(content_hash || ':' || n || ',', '' ORDER BY content_hash)) AS digest
FROM (SELECT scan_run_id, folder, content_hash, count(*) AS n
      FROM (SELECT *, unnest({_ancestors("full_path")}) AS folder FROM {files})
      WHERE content_hash IS NOT NULL GROUP BY ALL)
GROUP BY ALL"""


def _folders(files: str) -> str:
    return f"""
SELECT r.scan_run_id, full_path, {_leaf("full_path")} AS file_name, file_count, hashed_count, own_files,
  size_bytes, date_modified_utc, date_created_utc,
  CASE WHEN file_count = hashed_count THEN sha256(unhex(hashes || {_le64("file_count")})) END AS content_hash
FROM (
  SELECT scan_run_id, folder AS full_path, count(*) AS file_count, count(content_hash) AS hashed_count,
    CAST(count(*) FILTER (folder = parent) AS BIGINT) AS own_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
    max(date_modified_utc) AS date_modified_utc, min(date_created_utc) AS date_created_utc
  FROM (SELECT *, {_parent("full_path")} AS parent, unnest({_ancestors("full_path")}) AS folder FROM {files})
  GROUP BY scan_run_id, folder) r
LEFT JOIN (
  SELECT scan_run_id, folder, string_agg(digest, '' ORDER BY node) AS hashes
  FROM (SELECT scan_run_id, folder, substr(leaf, 1, 2) AS node, sha256(string_agg(digest, '' ORDER BY leaf)) AS digest
        FROM ({_leaves(files)}) GROUP BY ALL)
  GROUP BY ALL) h ON h.scan_run_id = r.scan_run_id AND h.folder = r.full_path"""


PARTS["folders"] = _folders("entries_files")
PARTS["line_folders"] = _folders("line_files")
PARTS["doc_folders"] = _folders(
    "(SELECT *, 'batch-' || sha256(drive) AS scan_run_id, raw_hash AS content_hash FROM inv_docs)"
)

PARTS["latest"] = """
SELECT drive, scan_run_id, completed_at_utc FROM scans_docs WHERE status = 'Completed' AND drive IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY drive ORDER BY completed_at_utc DESC, scan_run_id) = 1"""

PARTS["cur_files"] = """
SELECT * FROM entries_files
WHERE scan_run_id IN (SELECT scan_run_id FROM latest) AND content_hash IS NOT NULL"""

PARTS["cur_folders"] = """
SELECT full_path, file_name, content_hash, size_bytes FROM folders
WHERE scan_run_id IN (SELECT scan_run_id FROM latest) AND content_hash IS NOT NULL"""


def _sets(rows: str) -> str:
    return f"""
SELECT content_hash, size_bytes, count(*) AS copy_count, (count(*) - 1) * size_bytes AS wasted_bytes,
  min(file_name) AS file_name, count(DISTINCT file_name) AS distinct_name_count
FROM {rows} GROUP BY content_hash, size_bytes HAVING count(*) > 1"""


PARTS["file_sets"] = _sets("cur_files")
PARTS["line_sets"] = _sets("line_files")


def _pruning(folders: str, prefix: str) -> None:
    PARTS[f"{prefix}cand"] = f"""
SELECT full_path, file_name, content_hash, size_bytes FROM {folders}
WHERE content_hash IS NOT NULL QUALIFY count(*) OVER (PARTITION BY content_hash, size_bytes) > 1"""
    # No ancestor at all, not just the parent, may have the same content.
    PARTS[f"{prefix}indep"] = f"""
SELECT * FROM {prefix}cand f WHERE NOT EXISTS (
  SELECT 1 FROM {prefix}cand a WHERE a.content_hash = f.content_hash AND a.size_bytes = f.size_bytes
    AND {_beneath("f.full_path", "a.full_path")})"""
    PARTS[f"{prefix}dup"] = f"""
SELECT content_hash, size_bytes, count(*) AS cnt FROM {prefix}indep GROUP BY ALL HAVING count(*) > 1"""
    PARTS[f"{prefix}members"] = f"""
SELECT i.* FROM {prefix}indep i JOIN {prefix}dup d
  ON d.content_hash = i.content_hash AND d.size_bytes = i.size_bytes"""


_pruning("cur_folders", "")
_pruning("line_folders", "line_")

# Two ways to find the enclosing sets: by path prefix, and by listing ancestors (for the large inventory).
PARTS["cover"] = f"""
SELECT s.content_hash, s.size_bytes, t.content_hash AS cover_hash, t.size_bytes AS cover_size,
  CAST(count(DISTINCT s.full_path) AS BIGINT) AS covered_members
FROM members s, members t WHERE {_beneath("s.full_path", "t.full_path")} GROUP BY ALL"""
PARTS["line_cover"] = f"""
SELECT s.content_hash, s.size_bytes, t.content_hash AS cover_hash, t.size_bytes AS cover_size,
  count(DISTINCT s.full_path) AS covered_members
FROM (SELECT *, unnest({_ancestors("full_path")}) AS above FROM line_members) s
JOIN line_members t ON t.full_path = s.above GROUP BY ALL"""

for _prefix in ("", "line_"):
    PARTS[f"{_prefix}redundant"] = f"""
SELECT DISTINCT c.content_hash, c.size_bytes FROM {_prefix}cover c JOIN {_prefix}dup d
  ON d.content_hash = c.content_hash AND d.size_bytes = c.size_bytes WHERE c.covered_members = d.cnt"""
    PARTS[f"{_prefix}kept"] = f"""
SELECT * FROM {_prefix}indep i WHERE NOT EXISTS (SELECT 1 FROM {_prefix}redundant r
  WHERE r.content_hash = i.content_hash AND r.size_bytes = i.size_bytes)"""
PARTS["folder_sets"] = _sets("kept")
PARTS["line_folder_sets"] = _sets("line_kept")

PARTS["entries_all"] = """
SELECT scan_run_id, 'F' AS entry_type, file_name, full_path, size_bytes, date_modified_utc, date_created_utc,
  content_hash, scan_error FROM entries_files
UNION ALL SELECT scan_run_id, 'D', file_name, full_path, size_bytes, date_modified_utc, date_created_utc,
  content_hash, NULL FROM folders"""

PARTS["doc_entries"] = """
SELECT 'batch-' || sha256(drive) AS scan_run_id, 'F' AS entry_type, file_name, full_path,
  size_bytes, date_modified_utc, date_created_utc, raw_hash AS content_hash, CAST(NULL AS VARCHAR) AS scan_error
FROM inv_docs"""

# Every document as a file of its own; Spanish ones are reached by links only.
PARTS["stored_docs"] = """
SELECT source, lang, source || '/' || lang || '/' || file_name AS full_path, file_name, size_bytes, content_hash
FROM (SELECT source, lang, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS content_hash,
        CASE doc_id % 10 WHEN 3 THEN 'doc_' || chr(61439) || doc_id WHEN 4 THEN '.doc_' || doc_id
          WHEN 5 THEN 'doc #%20 ' || doc_id ELSE 'doc_' || doc_id || '.txt' END AS file_name
      FROM documents)"""
# Their folders from a source's folder on, in the shape of the other inventories.
PARTS["stored_folders"] = _folders(
    "(SELECT 'r' AS scan_run_id, 's3://' || full_path AS full_path, size_bytes, content_hash, "
    "CAST(NULL AS TIMESTAMP) AS date_modified_utc, CAST(NULL AS TIMESTAMP) AS date_created_utc "
    "FROM stored_docs WHERE lang <> 'es')"
)

PARTS["report_rows"] = """
SELECT 'files' AS section, * FROM file_sets WHERE wasted_bytes >= 2000
UNION ALL SELECT 'folders', * FROM folder_sets WHERE wasted_bytes >= 2000"""

PARTS["report_places"] = """
SELECT r.section, r.content_hash, r.size_bytes, c.full_path FROM report_rows r JOIN cur_files c
  ON r.section = 'files' AND c.content_hash = r.content_hash AND c.size_bytes = r.size_bytes
UNION ALL SELECT r.section, r.content_hash, r.size_bytes, c.full_path FROM report_rows r JOIN indep c
  ON r.section = 'folders' AND c.content_hash = r.content_hash AND c.size_bytes = r.size_bytes"""

# Sources

SQL["listing"] = """
SELECT drive AS root, full_path, file_name, size_bytes, date_modified_utc, date_created_utc FROM inv_docs"""
SQL["hash_files"] = "SELECT drive AS root, full_path, size_bytes, raw_hash AS content_hash FROM inv_docs"
SQL["hash_files_limited"] = """
SELECT full_path, size_bytes, CASE WHEN size_bytes <= 2000 THEN raw_hash END AS content_hash FROM inv_docs"""
SQL["exclude_links"] = "SELECT full_path FROM inv_docs WHERE NOT is_link AND lang <> 'fr'"
SQL["follow_links"] = "SELECT full_path FROM inv_docs WHERE NOT is_link"
SQL["skips"] = """
SELECT DISTINCT drive AS root, drive || lang || '/denied' AS full_path,
  'UnauthorizedAccessException: access denied' AS reason FROM inv_docs WHERE lang <> 'en'"""
SQL["listed_despite_skips"] = "SELECT drive AS root, full_path FROM inv_docs"
SQL["write_entries"] = "SELECT * FROM entries_all"
SQL["inventory"] = """
SELECT * FROM doc_entries
UNION ALL SELECT scan_run_id, 'D', file_name, full_path, size_bytes, date_modified_utc, date_created_utc,
  content_hash, NULL FROM doc_folders"""
SQL["metadata_only_inventory"] = "SELECT * REPLACE (CAST(NULL AS VARCHAR) AS content_hash) FROM doc_entries"
SQL["inventory_without_folders"] = "SELECT * FROM doc_entries"
SQL["scan_log_latest"] = f"""
SELECT 'batch-' || sha256(drive) AS scan_run_id, TIMESTAMP '2024-01-01 00:00:00' AS started_at_utc,
  TIMESTAMP '2024-01-02 00:00:00' AS completed_at_utc, 'Completed' AS status, 'host' AS machine_name, drive,
  drive AS roots, true AS compute_hash,
  (SELECT count(*) FROM entries_files e WHERE {_root("e.full_path")} = drive) AS files_written,
  CAST(NULL AS VARCHAR) AS scan_error
FROM (SELECT DISTINCT drive FROM scans_docs WHERE drive IS NOT NULL)"""

SQL["file_listing"] = "SELECT full_path, file_name, size_bytes FROM stored_docs WHERE lang <> 'es'"
SQL["linked_file_listing"] = "SELECT full_path, file_name, size_bytes FROM stored_docs"
SQL["multi_root_listing"] = """
SELECT source AS root, full_path, size_bytes FROM stored_docs WHERE lang <> 'es' UNION ALL SELECT 'none', 'none', NULL"""
SQL["file_hashes"] = "SELECT full_path, content_hash, CAST(NULL AS VARCHAR) AS error FROM stored_docs"
SQL["inventory_of_files"] = """
SELECT 'F' AS entry_type, full_path, file_name, size_bytes, content_hash FROM stored_docs WHERE lang <> 'es'
UNION ALL SELECT 'D', rtrim(substr(full_path, 6), '/'), string_split(rtrim(full_path, '/'), '/')[-1], size_bytes, content_hash
FROM stored_folders"""
SQL["root_outcomes"] = """
SELECT source AS root, 'Completed' AS status, count(*) FILTER (lang <> 'es') AS files_written, 0 AS folders_skipped
FROM documents GROUP BY source
UNION ALL SELECT 'none', 'Completed', 0, 1 UNION ALL SELECT 'folder', 'Failed', 0, 1"""

# Runs

SQL["latest_runs"] = "SELECT * FROM latest"
SQL["latest_runs_for_drives"] = "SELECT * FROM latest WHERE drive IN ('s3://src1/', 's3://src7/')"
SQL["latest_runs_of_events"] = """
SELECT drive, scan_run_id, completed_at_utc FROM event_scans WHERE status = 'Completed' AND drive IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY drive ORDER BY completed_at_utc DESC, scan_run_id) = 1"""
SQL["incomplete_runs"] = "SELECT * FROM event_scans WHERE status = 'Running' OR completed_at_utc IS NULL"
SQL["batch_outcome"] = """
SELECT CASE w WHEN 2 THEN 'Failed' WHEN 1 THEN 'Canceled' ELSE 'Completed' END AS status,
  CAST(CASE w WHEN 2 THEN 1 WHEN 1 THEN 130 ELSE 0 END AS BIGINT) AS exit_code
FROM (SELECT max(CASE status WHEN 'Failed' THEN 2 WHEN 'Canceled' THEN 1 WHEN 'Completed' THEN 0 END) AS w
      FROM scans_docs)"""
SQL["run_durations"] = """
SELECT scan_run_id, drive, s AS duration_seconds,
  lpad(CAST(s // 3600 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':'
    || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS elapsed
FROM (SELECT *, date_diff('second', started_at_utc, completed_at_utc) AS s FROM scans_docs
      WHERE completed_at_utc IS NOT NULL)"""
SQL["current_entries"] = """
SELECT scan_run_id, 'F' AS entry_type, file_name, full_path, size_bytes, date_modified_utc, date_created_utc,
  content_hash, scan_error FROM entries_files WHERE scan_run_id IN (SELECT scan_run_id FROM latest)"""

# Duplicate files

_TOP = "ORDER BY wasted_bytes DESC, content_hash, size_bytes LIMIT 10"
SQL["dup_file_sets"] = "SELECT * FROM file_sets"
SQL["dup_file_sets_over_threshold"] = "SELECT * FROM file_sets WHERE wasted_bytes >= 2000"
SQL["total_wasted"] = "SELECT CAST(coalesce(sum(wasted_bytes), 0) AS BIGINT) AS total_wasted_bytes FROM file_sets"
SQL["adhoc_duplicates"] = """
SELECT content_hash, count(*) AS copies, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM entries_files
WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1"""
SQL["top_dup_files"] = f"SELECT * FROM file_sets {_TOP}"
SQL["dup_file_locations"] = """
SELECT c.content_hash, c.size_bytes, c.full_path FROM cur_files c JOIN file_sets s
  ON s.content_hash = c.content_hash AND s.size_bytes = c.size_bytes"""

SQL["top_dup_file_locations"] = f"""
SELECT c.content_hash, c.size_bytes, c.full_path FROM cur_files c JOIN (SELECT * FROM file_sets {_TOP}) s
  ON s.content_hash = c.content_hash AND s.size_bytes = c.size_bytes"""


def _samples(rows: str, sets: str, k: int) -> str:
    return f"""
SELECT c.content_hash, c.size_bytes, c.full_path,
  row_number() OVER (PARTITION BY c.content_hash, c.size_bytes ORDER BY c.full_path) AS position
FROM {rows} c JOIN {sets} s ON s.content_hash = c.content_hash AND s.size_bytes = c.size_bytes
QUALIFY position <= {k}"""


SQL["dup_file_samples"] = _samples("cur_files", "file_sets", 5)
SQL["lineitem_file_sets"] = "SELECT * FROM line_sets"
SQL["lineitem_top_files"] = f"SELECT * FROM line_sets {_TOP}"
SQL["lineitem_file_samples"] = _samples("line_files", "line_sets", 2)

# Folders

SQL["folder_rollup"] = """
SELECT scan_run_id, full_path, file_count, hashed_count, size_bytes, date_modified_utc, date_created_utc, own_files
FROM folders"""
SQL["folder_fingerprints"] = "SELECT scan_run_id, full_path, file_name, size_bytes, content_hash FROM folders"


def _chains(files: str) -> str:
    return f"""
SELECT scan_run_id, folder AS full_path,
  sha256(unhex(string_agg(content_hash, '' ORDER BY content_hash) || {_le64("count(*)")})) AS chain_hash
FROM (SELECT scan_run_id, content_hash, unnest({_ancestors("full_path")}) AS folder FROM {files})
GROUP BY ALL HAVING count(*) = count(content_hash)"""


SQL["folder_fingerprints_chained"] = _chains("entries_files")
SQL["lineitem_folders_chained"] = _chains("line_files")
_LANES = ", ".join(
    f"CAST(sum(CAST('0x' || substr(content_hash, {1 + 6 * i}, 6) AS BIGINT)) AS BIGINT) AS lane_{i}" for i in range(4)
)
SQL["folder_summaries"] = f"""
SELECT scan_run_id, folder AS full_path, count(*) AS file_count, count(content_hash) AS hashed_count, {_LANES}
FROM (SELECT *, unnest({_ancestors("full_path")}) AS folder FROM entries_files) GROUP BY ALL"""
SQL["folder_fingerprints_digested"] = f"""
SELECT c.scan_run_id, c.folder AS full_path, leaf, digest
FROM ({_leaves("entries_files")}) c
JOIN folders f ON f.scan_run_id = c.scan_run_id AND f.full_path = c.folder AND f.file_count = f.hashed_count"""
SQL["lineitem_folder_fingerprints"] = "SELECT full_path, size_bytes, content_hash FROM line_folders"
SQL["dup_folder_candidates"] = "SELECT * FROM cand"
SQL["independent_folders"] = "SELECT * FROM indep"
SQL["dup_folder_members"] = "SELECT * FROM members"
SQL["folder_ancestors"] = f"""
SELECT content_hash, size_bytes, parent, siblings,
  unnest(CASE WHEN parent LIKE '%/' THEN [parent] ELSE list_append({_ancestors("parent")}, parent) END) AS ancestor
FROM (SELECT content_hash, size_bytes, {_parent("full_path")} AS parent, count(DISTINCT full_path) AS siblings
      FROM members GROUP BY ALL) WHERE parent IS NOT NULL"""
SQL["folder_cover"] = "SELECT * FROM cover"
SQL["redundant_folder_sets"] = "SELECT * FROM redundant"
SQL["dup_folder_sets"] = "SELECT * FROM folder_sets"
SQL["top_dup_folders"] = f"SELECT * FROM folder_sets {_TOP}"
SQL["dup_folder_locations"] = """
SELECT i.content_hash, i.size_bytes, i.full_path FROM indep i JOIN folder_sets s
  ON s.content_hash = i.content_hash AND s.size_bytes = i.size_bytes"""
SQL["dup_folder_samples"] = _samples("indep", "folder_sets", 1)
SQL["lineitem_folder_sets"] = "SELECT * FROM line_folder_sets"

# Reports


def _preview(sets: str, rows: str, label: str) -> str:
    return f"""
WITH top AS (SELECT *, row_number() OVER ({_TOP.split(" LIMIT")[0]}) AS rank FROM {sets} {_TOP}),
samples AS ({_samples(rows, "top", 3)}),
shown AS (SELECT content_hash, size_bytes, string_agg(full_path, chr(10) ORDER BY full_path) AS locations,
  count(*) AS n FROM samples GROUP BY ALL)
SELECT rank, '#' || rpad(CAST(rank AS VARCHAR), greatest(2, length(CAST(rank AS VARCHAR)))::INT, ' ') || ' '
    || lpad(waste, greatest(11, length(waste))::INT, ' ') || ' wasted  |  '
    || CASE WHEN distinct_name_count = 1 THEN file_name ELSE '{label}' END || '  |  ' || copy_count
    || ' copies × ' || size || '  |  hash ' || substr(t.content_hash, 1, 12) || '…' AS headline,
  locations, CASE WHEN copy_count > n THEN '… and ' || (copy_count - n) || ' more location(s)' END AS remainder
FROM (SELECT *, {_bytes("wasted_bytes")} AS waste, {_bytes("size_bytes")} AS size FROM top) t
JOIN shown s ON s.content_hash = t.content_hash AND s.size_bytes = t.size_bytes"""


SQL["preview_files"] = _preview("file_sets", "cur_files", "<filenames differ>")
SQL["preview_folders"] = _preview("folder_sets", "indep", "<folder names differ>")
SQL["report_sets"] = """
SELECT section, CASE WHEN distinct_name_count = 1 THEN file_name END AS name, distinct_name_count > 1 AS names_differ,
  content_hash, size_bytes, copy_count, wasted_bytes FROM report_rows"""
SQL["report_locations"] = "SELECT * FROM report_places"


def _line(section: str, line: str, where: str, wasted="NULL", content="NULL", size="NULL", part="0", path="NULL"):
    return (
        f"SELECT CAST({section} AS BIGINT) AS section, CAST({wasted} AS BIGINT) AS wasted_bytes, "
        f"CAST({content} AS VARCHAR) AS content_hash, CAST({size} AS BIGINT) AS size_bytes, "
        f"CAST({part} AS BIGINT) AS part, CAST({path} AS VARCHAR) AS full_path, {line} AS line {where}"
    )


_NUMBER = "CASE r.section WHEN 'files' THEN 2 ELSE 3 END"
SQL["report_yaml"] = "\nUNION ALL ".join([
    _line("0", "'# Duplicate files and folders.' || chr(10) || "
          "'# Sets that waste less are left out: 1.95 KB (2000 bytes).' || chr(10) || chr(10) || "
          "'generatedUtc: \"2024-02-01T12:30:45Z\"' || chr(10) || 'wastedSpaceThresholdBytes: 2000' || chr(10) || "
          "'totalWastedBytes: ' || (SELECT CAST(sum(wasted_bytes) AS BIGINT) FROM file_sets)", ""),
    _line("1", "'scans:'", ""),
    _line("1", f"'  - drive: ' || {_quote('drive')} || chr(10) || '    scanRunId: ' || {_quote('scan_run_id')} "
          f"|| chr(10) || '    completedUtc: \"' || {_iso('completed_at_utc')} || '\"'", "FROM latest",
          part="1", path="drive"),
    _line("2", "'duplicateFileSets:'", ""),
    _line("3", "'duplicateFolderSets:'", ""),
    _line(_NUMBER,
          f"'  - name: ' || CASE WHEN distinct_name_count > 1 THEN 'null' ELSE {_quote('file_name')} END || chr(10) "
          "|| '    namesDiffer: ' || CASE WHEN distinct_name_count > 1 THEN 'true' ELSE 'false' END || chr(10) "
          f"|| '    contentHash: ' || {_quote('content_hash')} || chr(10) || '    sizeBytes: ' || size_bytes || chr(10) "
          "|| '    copyCount: ' || copy_count || chr(10) || '    wastedBytes: ' || wasted_bytes || chr(10) "
          "|| '    locations:'", "FROM report_rows r", "wasted_bytes", "content_hash", "size_bytes", "1"),
    _line(_NUMBER, f"'      - ' || {_quote('p.full_path')}",
          "FROM report_rows r JOIN report_places p ON p.section = r.section AND p.content_hash = r.content_hash "
          "AND p.size_bytes = r.size_bytes",
          "r.wasted_bytes", "r.content_hash", "r.size_bytes", "2", "p.full_path"),
])

# Retention and tallies

SQL["cleanup_counts"] = """
SELECT (SELECT count(*) FROM entries_all WHERE scan_run_id NOT IN (SELECT scan_run_id FROM latest)) AS files_to_delete,
  (SELECT count(*) FROM skips_docs WHERE scan_run_id NOT IN (SELECT scan_run_id FROM latest)) AS skips_to_delete"""
SQL["whole_chain"] = f"""
SELECT *, (SELECT count(*) FROM stored_docs WHERE lang <> 'es') AS files_kept, true AS files_deleted
FROM ({_sets("(SELECT * FROM stored_docs WHERE lang <> 'es')")}) {_TOP}"""
SQL["missing_tables"] = """
SELECT 'entries' AS name, (SELECT count(*) FROM entries_all) AS written, 0 AS absent
UNION ALL SELECT 'skips', (SELECT count(*) FROM skips_docs), 0 UNION ALL SELECT 'scans', (SELECT count(*) FROM scans_docs), 0"""
SQL["cleanup_retained"] = "SELECT * FROM entries_all WHERE scan_run_id IN (SELECT scan_run_id FROM latest)"
SQL["cleanup_in_place"] = SQL["cleanup_retained"]
SQL["merge_hashes"] = """
SELECT scan_run_id, full_path, content_hash, coalesce(scan_error,
  CASE WHEN content_hash IS NULL THEN 'IOException: second try' END) AS scan_error FROM entries_files"""

PARTS["totals"] = """
SELECT scan_run_id, CAST(sum(f) AS BIGINT) AS files_seen, CAST(sum(f) AS BIGINT) AS rows_written,
  CAST(sum(h) AS BIGINT) AS files_hashed, CAST(sum(d) AS BIGINT) AS folders_written,
  CAST(sum(s) AS BIGINT) AS directories_skipped, CAST(sum(e) AS BIGINT) AS hash_errors
FROM (SELECT scan_run_id, 1 AS f, CAST(content_hash IS NOT NULL AS INT) AS h, 0 AS d, 0 AS s,
        CAST(scan_error IS NOT NULL AS INT) AS e FROM entries_files
      UNION ALL SELECT scan_run_id, 0, 0, 1, 0, 0 FROM folders
      UNION ALL SELECT scan_run_id, 0, 0, 0, 1, 0 FROM skips_docs) GROUP BY scan_run_id"""
SQL["scan_totals_by_run"] = "SELECT * FROM totals"
SQL["scan_totals"] = "SELECT " + ", ".join(
    f"CAST(sum({name}) AS BIGINT) AS {name}"
    for name in ["files_seen", "rows_written", "files_hashed", "folders_written", "directories_skipped", "hash_errors"]
) + " FROM totals"
SQL["hash_coverage"] = """
SELECT *, (files_handled::DOUBLE / files + bytes_hashed::DOUBLE / bytes) / 2 AS coverage
FROM (SELECT scan_run_id, count(*) AS files,
        count(*) FILTER (content_hash IS NOT NULL OR scan_error IS NOT NULL) AS files_handled,
        CAST(sum(size_bytes) AS BIGINT) AS bytes,
        CAST(coalesce(sum(size_bytes) FILTER (content_hash IS NOT NULL), 0) AS BIGINT) AS bytes_hashed
      FROM entries_files GROUP BY scan_run_id)"""

# Scalar functions: the segments of each path are known, so every style is assembled from them.

PARTS["styled"] = """
SELECT r AS root, j AS joiner, s AS sep,
  [source, lang, 'b' || (doc_id // 20 % 5), 'doc_' || doc_id || '.txt'][o:] AS segments
FROM (SELECT doc_id, lang, source, unnest([
    {'r': 's3://' || source || '/', 'j': '', 's': '/', 'o': 2}, {'r': '/', 'j': '', 's': '/', 'o': 1},
    {'r': 'C:\\', 'j': '', 's': '\\', 'o': 1}, {'r': '\\\\srv\\share', 'j': '\\', 's': '\\', 'o': 1}],
    max_depth := 1) AS st FROM documents) x, LATERAL (SELECT st.r AS r, st.j AS j, st.s AS s, st.o AS o)"""
_JOIN = "list_reduce({}, lambda a, b: a || sep || b)"
PARTS["pathed"] = f"""
SELECT root || joiner || {_JOIN.format("segments")} AS path,
  root || joiner || {_JOIN.format("segments[1:-2]")} AS parent,
  root || '|' || array_to_string(list_transform(generate_series(1, len(segments) - 1), lambda i:
    root || joiner || {_JOIN.format("segments[1:i]")}), '|') AS ancestors,
  segments[-1] AS leaf FROM styled
UNION ALL SELECT 's3://' || source || '/', NULL, '', 's3://' || source || '/' FROM documents"""
SQL["path_functions"] = "SELECT * FROM pathed"
SQL["parent_path_sql"] = "SELECT path, parent FROM pathed"
SQL["normalize_drive"] = """
SELECT c_custkey, p.raw, p.drive FROM (SELECT c_custkey, unnest([
  {'raw': lower(left(c_name, 1)), 'drive': upper(left(c_name, 1)) || ':\\'},
  {'raw': left(c_name, 1) || ':', 'drive': upper(left(c_name, 1)) || ':\\'},
  {'raw': c_name, 'drive': c_name || '\\'}, {'raw': '/' || c_name, 'drive': '/' || c_name || '/'},
  {'raw': 's3://' || c_name || '/', 'drive': 's3://' || c_name || '/'}], max_depth := 1) AS p FROM customer)"""
SQL["format_bytes"] = f"""
SELECT size_bytes, {_bytes("size_bytes")} AS label FROM (
  SELECT DISTINCT m * l_partkey * CAST(l_quantity AS BIGINT) AS size_bytes
  FROM lineitem, (VALUES (1), (37), (4099), (262144), (41943040), (9663676416)) AS f(m))"""
SQL["display_stamps"] = f"""
SELECT event_id, {_iso("ts")} AS iso, strftime(ts, '%Y%m%d-%H%M%S') AS file_stamp,
  strftime(ts, '%Y-%m-%d %H:%M') AS display_stamp FROM events"""
SQL["yaml_quoted"] = f"SELECT page_id, {_quote('html')} AS quoted FROM pages"


def _needed(text: str, found: list[str]) -> list[str]:
    for name in PARTS:
        if name not in found and re.search(rf"\b(?:FROM|JOIN|,)\s+\(?{name}\b", text):
            _needed(PARTS[name], found)
            found.append(name)
    return found


def complete(text: str) -> str:
    """A query preceded by the parts it reads, each after those it reads itself."""
    parts = ",\n".join(f"{name} AS ({PARTS[name]})" for name in _needed(text, []))
    if not parts:
        return text
    body = text.strip()
    if body.startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"
