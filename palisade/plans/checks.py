"""Shared DuckDB statements: the domain views of ``views.py`` as common table expressions."""

from __future__ import annotations

from ..functions.paths import SUSPICIOUS_FOLDERS
from ..schemas import EVENT_IDS, FILE_EVENT_IDS, REGISTRY_EVENT_IDS, ZERO_GUID

_TEL = rf"""
ev AS (SELECT event_id AS row_id, ts AS "timestamp", user_id, event_type, value,
              CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k FROM events),
tel AS (SELECT *,
  CASE k % 10 WHEN 0 THEN '1' WHEN 1 THEN '3' WHEN 2 THEN '7' WHEN 3 THEN '11' WHEN 4 THEN '12' WHEN 5 THEN '13'
    WHEN 6 THEN '23' WHEN 7 THEN '26' WHEN 8 THEN '22' ELSE 'bad' END AS event_id,
  'host-' || (user_id % 5) AS computer,
  CASE user_id % 10 WHEN 0 THEN '' WHEN 1 THEN '{ZERO_GUID}' ELSE '{{' || user_id || '}}' END AS process_guid,
  CASE WHEN user_id % 50 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS process_id,
  'C:\bin\' || event_type || '.exe' AS image,
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'C:/Users/u/AppData/f' || k || '.DAT'
    WHEN 2 THEN 'C:\Temp\f' || k || '.' || event_type ELSE 'D:\data\f' || k END AS target_filename,
  CASE WHEN k % 10 = 5 THEN 'HKLM\k' || k END AS target_object,
  CASE WHEN k % 10 = 1 THEN '10.0.0.' || (k % 16) ELSE '' END AS destination_ip,
  CASE k % 3 WHEN 0 THEN 'vssadmin delete shadows' WHEN 1 THEN 'CMD.EXE /C whoami' ELSE 'notepad' END AS command_line,
  'log-' || (user_id % 11) AS source,
  CASE WHEN user_id % 11 < 5 THEN 1 ELSE 0 END AS label,
  'scenario-' || (user_id % 4) AS scenario,
  CASE user_id % 6 WHEN 0 THEN 'T1486' WHEN 1 THEN 'T1490' WHEN 2 THEN 'benign' WHEN 3 THEN 'T1059.001'
    WHEN 4 THEN 'Monitoring' ELSE 'T1547' END AS technique_id,
  least(value, 100.0) / 100 AS risk
  FROM ev)"""

_FILT = rf"""
filt AS (SELECT * REPLACE (CAST(event_id AS INTEGER) AS event_id) FROM tel
  WHERE event_id IN ({', '.join(f"'{i}'" for i in EVENT_IDS)}) AND "timestamp" IS NOT NULL
    AND (process_guid <> '' OR process_id <> ''))"""

_ROWS = rf"""
wrows AS (SELECT *,
  CASE WHEN process_guid IN ('', '{ZERO_GUID}') THEN process_id || ':' || image ELSE process_guid END AS process_key,
  lower(replace(target_filename, '/', '\')) AS npath,
  regexp_extract(lower(replace(target_filename, '/', '\')), '\.([a-z0-9]{{1,12}})$', 1) AS extension
  FROM filt)"""

FLOOR = "(TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch({ts}) / {n}) * {n} AS BIGINT)))"

AGGS = rf"""
  count(*) AS event_count, count(DISTINCT image) AS unique_images,
  count(DISTINCT nullif(target_filename, '')) AS unique_files,
  count(DISTINCT nullif(extension, '')) AS unique_extensions,
  count(DISTINCT nullif(destination_ip, '')) AS unique_destination_ips,
  count(*) FILTER ({" OR ".join(f"contains(npath, '{f}')" for f in SUSPICIOUS_FOLDERS)}) AS suspicious_path_count,
  count(*) FILTER (event_id IN {FILE_EVENT_IDS}) AS file_activity_count,
  count(*) FILTER (event_id IN {REGISTRY_EVENT_IDS}) AS registry_activity_count,
  count(*) FILTER (event_id = 3) AS network_activity_count,
  {', '.join(f'count(*) FILTER (event_id = {i}) AS event_{i}_count' for i in EVENT_IDS)}"""


def _windows(name: str, seconds: int, extra: str = "") -> str:
    floor = FLOOR.format(ts='"timestamp"', n=seconds)
    return (f"{name} AS (SELECT computer, process_key, {floor} AS window_start, {AGGS}{extra} "
            f"FROM wrows GROUP BY ALL)")


_SCORED = _windows("scored", 86_400, """,
  round(max(risk), 6) AS risk_score, round(min(risk) - 0.3, 6) AS anomaly_score, min(source) AS source,
  max(label) AS label, min(scenario) AS scenario, min(technique_id) AS technique_id, min(row_id) AS window_id""")

_SAMPLES = r"""
samples AS (SELECT o_orderkey AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS sample_type,
  o_orderpriority AS source, 'family-' || (o_custkey % 16) AS ransomware_family,
  CASE o_orderstatus WHEN 'F' THEN 'goodware' WHEN 'O' THEN 'crypto' ELSE 'locker' END AS ransomware_type,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS type_label,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS submitted,
  CAST(o_orderdate AS DATE) AS first_submission, o_totalprice AS size FROM orders)"""

_PRESENCE = r"""
presence AS (SELECT DISTINCT doc_id AS sample_id, w AS name FROM
  (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents)
  WHERE w <> ''),
plabels AS (SELECT doc_id AS sample_id, quality AS label, toxic FROM labels)"""

_VECTORS = (r"""
vectors AS (SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, label AS type_label, """
            + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64)) + " FROM embeddings)")

_NEEDS = {"tel": [_TEL], "filt": [_TEL, _FILT], "wrows": [_TEL, _FILT, _ROWS],
          "windows": [_TEL, _FILT, _ROWS, _windows("windows", 86_400)],
          "scored": [_TEL, _FILT, _ROWS, _SCORED],
          "samples": [_SAMPLES], "presence": [_PRESENCE], "vectors": [_VECTORS]}


def over(view: str, body: str) -> str:
    """``body`` may start with further CTEs written as ``, name AS (...)`` before its SELECT."""
    return "WITH " + ",".join(_NEEDS[view]) + "\n" + body
