"""Queries on events and windows: projections, filters, scalar helpers, window aggregates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import functions as X
from ..functions.risk import BENIGN_TECHNIQUES
from ..functions.text import TOOL_NAMES
from ..operators import counts, sequences, serving
from ..operators import episodes as E
from ..operators import telemetry as T
from ..operators import vectors as M
from ..schemas import EVENT_IDS, WINDOW_FEATURES, WINDOW_KEY
from . import views as V
from .checks import over
from .registry import query

KEY = ", ".join(WINDOW_KEY)


# ---- window aggregates -------------------------------------------------------------------------

@query("process_windows", over("windows", "SELECT * FROM windows"))
def process_windows(spark, sf):
    return V.windows(spark, sf)


@query("window_order", over("windows", f"SELECT {KEY}, event_count FROM windows ORDER BY ALL"))
def window_order(spark, sf):
    return V.windows(spark, sf).select(*WINDOW_KEY, "event_count").orderBy(*WINDOW_KEY)


@query("event_type_counts", over("wrows", r"""
SELECT computer, count(*) AS event_count,
  count(*) FILTER (event_id = 1) AS event_1_count, count(*) FILTER (event_id = 3) AS event_3_count,
  count(*) FILTER (event_id = 7) AS event_7_count, count(*) FILTER (event_id = 11) AS event_11_count,
  count(*) FILTER (event_id = 12) AS event_12_count, count(*) FILTER (event_id = 13) AS event_13_count,
  count(*) FILTER (event_id = 23) AS event_23_count, count(*) FILTER (event_id = 26) AS event_26_count
FROM wrows GROUP BY computer"""))
def event_type_counts(spark, sf):
    events = T.windowed_rows(T.event_filter(V.telemetry(spark, sf)))
    return T.count_features(events, ("computer",)).select("computer", "event_count", *(f"event_{i}_count" for i in EVENT_IDS))


@query("activity_counts", over("wrows", r"""
SELECT process_key, count(*) FILTER (event_id IN (11, 23, 26)) AS file_activity_count,
  count(*) FILTER (event_id IN (12, 13)) AS registry_activity_count,
  count(*) FILTER (event_id = 3) AS network_activity_count,
  count(*) FILTER (regexp_matches(npath, '\\(temp|appdata|downloads|public)\\')) AS suspicious_path_count
FROM wrows GROUP BY process_key"""))
def activity_counts(spark, sf):
    events = T.windowed_rows(T.event_filter(V.telemetry(spark, sf)))
    return T.count_features(events, ("process_key",)).select(
        "process_key", "file_activity_count", "registry_activity_count", "network_activity_count", "suspicious_path_count")


@query("distinct_counts", over("wrows", r"""
SELECT computer, count(DISTINCT image) AS unique_images, count(DISTINCT nullif(target_filename, '')) AS unique_files,
  count(DISTINCT nullif(extension, '')) AS unique_extensions,
  count(DISTINCT nullif(destination_ip, '')) AS unique_destination_ips FROM wrows GROUP BY computer"""))
def distinct_counts(spark, sf):
    events = T.windowed_rows(T.event_filter(V.telemetry(spark, sf)))
    return T.count_features(events, ("computer",)).select("computer", *T.DISTINCT_FACTS)


TOOLS = "'" + "|".join(re.escape(n).replace(r"\ ", " ") for n in TOOL_NAMES) + "'"
COUNT_STREAM = r"""WITH stream AS (SELECT *, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1) // 10 AS chunk FROM (
  SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS class,
    CASE l_suppkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 11 WHEN 4 THEN 12 WHEN 5 THEN 13
      WHEN 6 THEN 23 WHEN 7 THEN 26 END AS code,
    CASE WHEN l_suppkey % 7 <> 0 THEN 'C:\bin\' || l_returnflag || l_linestatus || '.exe' END AS image,
    CASE l_partkey % 4 WHEN 0 THEN 'C:\d.x\file' || (l_partkey % 20) WHEN 1 THEN 'C:\d\f' || (l_partkey % 20) || '.DOCXY'
      WHEN 2 THEN 'C:\d\f.' || (l_partkey % 3) END AS target,
    CASE CAST(l_quantity AS BIGINT) % 3 WHEN 0 THEN 'VSSADMIN list' WHEN 1 THEN 'cmd.exe /c dir' ELSE 'notepad' END AS cmd
  FROM lineitem)),
cw AS (SELECT chunk, TIMESTAMP '2026-08-06 00:00:00' + to_seconds(chunk * 10) AS window_start, count(*) AS event_count,
  count(DISTINCT image) AS unique_images, count(DISTINCT target) AS unique_files,
  count(DISTINCT CASE WHEN contains(string_split(target, '\')[-1], '.')
    THEN lower(substring(string_split(target, '.')[-1], 1, 4)) END) AS unique_extensions,
  CASE WHEN count(*) FILTER (code = 3) > 0 THEN count(DISTINCT target) ELSE 0 END AS unique_destination_ips,
  count(*) FILTER (regexp_matches(lower(cmd), {TOOLS})) AS suspicious_path_count,
  count(*) FILTER (code IN (11, 23, 26)) AS file_activity_count, count(*) FILTER (code IN (12, 13)) AS registry_activity_count,
  count(*) FILTER (code = 3) AS network_activity_count,
  """.replace("{TOOLS}", TOOLS) + ", ".join(f"count(*) FILTER (code = {i}) AS event_{i}_count" for i in (1, 3, 7, 11, 12, 13, 23, 26)) + r""",
  CASE WHEN count(*) FILTER (class = 1) > count(*) FILTER (class = 0) THEN 1 ELSE 0 END AS label
  FROM stream GROUP BY chunk)
"""


def _count_stream(spark, sf):
    part = F.col("l_partkey")
    code = V._pick(F.col("l_suppkey") % 9, "1", "3", "7", "11", "12", "13", "23", "26", None)
    target = (F.when(part % 4 == 0, F.concat(F.lit("C:\\d.x\\file"), part % 20))
              .when(part % 4 == 1, F.concat(F.lit("C:\\d\\f"), part % 20, F.lit(".DOCXY")))
              .when(part % 4 == 2, F.concat(F.lit("C:\\d\\f."), part % 3)))
    lines = V.table(spark, sf, "lineitem")
    return lines.withColumns({
        "class": F.when(F.col("l_returnflag") == "R", 1).otherwise(0), "code": code, "target": target,
        "image": F.when(F.col("l_suppkey") % 7 != 0,
                        F.concat(F.lit("C:\\bin\\"), "l_returnflag", "l_linestatus", F.lit(".exe"))),
        "command_line": V._pick(F.col("l_quantity").cast("long") % 3, "VSSADMIN list", "cmd.exe /c dir", "notepad")})


LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query("count_windows", COUNT_STREAM + """SELECT * EXCLUDE (chunk), 'endpoint-01' AS computer,
  printf('PROC-%05d', chunk) AS process_key, CASE label WHEN 0 THEN 'benign' ELSE 'attack' END AS scenario,
  'lines_log_' || (chunk % 5 + 1) AS source, CASE label WHEN 0 THEN 'benign' ELSE 'attack' END AS source_kind,
  'lines' AS dataset_source, 'raw_sysmon' AS representation FROM cw""")
def count_windows(spark, sf):
    return counts.count_windows(_count_stream(spark, sf), LINE_ORDER, dataset="lines")


@query("majority_label", COUNT_STREAM + "SELECT window_start, label FROM cw")
def majority_label(spark, sf):
    return count_windows(spark, sf).select("window_start", "label")


@query("destination_count", COUNT_STREAM + "SELECT window_start, network_activity_count, unique_destination_ips FROM cw")
def destination_count(spark, sf):
    return count_windows(spark, sf).select("window_start", "network_activity_count", "unique_destination_ips")


@query("chunk_index", """SELECT event_id AS row_id,
  (row_number() OVER (ORDER BY ts, event_id) - 1) // 10 AS chunk FROM events""")
def chunk_index(spark, sf):
    events = V.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "ts")
    return counts.chunk_index(events, ("ts", "row_id"), 10).select("row_id", "chunk")


# ---- projections -------------------------------------------------------------------------------

@query("conform_columns", over("tel", """SELECT row_id, coalesce(target_object, '') AS target_object,
  '' AS parent_image, CAST(k AS VARCHAR) AS k FROM tel"""))
def conform_columns(spark, sf):
    return T.conform_columns(V.telemetry(spark, sf), ("target_object", "parent_image", "k")).select(
        "row_id", "target_object", "parent_image", "k")


@query("process_key", over("wrows", "SELECT row_id, process_key FROM wrows"))
def process_key(spark, sf):
    rows = T.conform_columns(T.event_filter(V.telemetry(spark, sf)))
    return rows.select("row_id", T.process_key().alias("process_key"))


@query("timestamp_coerce", over("tel", 'SELECT row_id, "timestamp" FROM tel WHERE k % 5 <> 0'))
def timestamp_coerce(spark, sf):
    text = F.when(F.col("k") % 5 != 0, F.col("timestamp").cast("string")).when(F.col("k") % 2 == 0, "soon")
    rows = T.coerce_timestamps(V.telemetry(spark, sf).withColumn("timestamp", text))
    return rows.select("row_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("path_lineage", over("tel", """SELECT row_id,
  CASE k % 3 WHEN 0 THEN 'T' || k ELSE 'unknown' END AS technique_id,
  CASE k % 3 WHEN 0 THEN 'scn-' || user_id WHEN 1 THEN 'h' || user_id ELSE 'attack_techniques' END AS scenario FROM tel"""))
def path_lineage(spark, sf):
    k, user = F.col("k"), F.col("user_id")
    path = (F.when(k % 3 == 0, F.concat(F.lit("/d/attack_techniques/T"), k, F.lit("/scn-"), user, F.lit("/x.log")))
            .when(k % 3 == 1, F.concat(F.lit("/d/benign/h"), user, F.lit("/x.log")))
            .otherwise(F.concat(F.lit("/d/attack_techniques/T"), k)))
    technique, scenario = X.path_lineage(path)
    return V.telemetry(spark, sf).select("row_id", technique.alias("technique_id"), scenario.alias("scenario"))


@query("label_windows", over("windows", f"""SELECT {KEY}, event_count, 1 AS label, 'T1486' AS technique_id,
  computer AS scenario, '/d/attack_techniques/T1486/' || computer || '/x.log' AS source, 'attack' AS source_kind,
  'lab' AS dataset_source, 'raw_sysmon' AS representation FROM windows"""))
def label_windows(spark, sf):
    source = F.concat(F.lit("/d/attack_techniques/T1486/"), F.col("computer"), F.lit("/x.log"))
    return T.label_windows(V.windows(spark, sf).select(*WINDOW_KEY, "event_count"), 1, "attack", source, "lab")


@query("feature_columns", over("windows", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST(sum({f}) AS BIGINT) AS total FROM windows" for f in WINDOW_FEATURES)))
def feature_columns(spark, sf):
    windows = V.windows(spark, sf).withColumn("label", F.lit(1))
    names = M.feature_columns(windows)
    totals = windows.agg(*(F.sum(n).alias(n) for n in names))
    return totals.unpivot([], names, "feature", "total")


@query("vectorize", over("windows", f"""SELECT {KEY}, {', '.join(
    f'CAST({f} AS DOUBLE) AS {f}' if f != 'unique_files' else 'CAST(coalesce(nullif(unique_files, 1), 0) AS DOUBLE) AS unique_files'
    for f in WINDOW_FEATURES)} FROM windows"""))
def vectorize(spark, sf):
    holes = V.windows(spark, sf).withColumn("unique_files", F.nullif("unique_files", F.lit(1)))
    return M.vectorize(holes, keep=WINDOW_KEY)


@query("align_to_model", over("windows", f"""SELECT {KEY}, CAST(event_3_count AS DOUBLE) AS event_3_count,
  CAST(0 AS DOUBLE) AS entropy, CAST(event_count AS DOUBLE) AS event_count FROM windows"""))
def align_to_model(spark, sf):
    return M.align_to_model(V.windows(spark, sf), ("event_3_count", "entropy", "event_count"), keep=WINDOW_KEY)


@query("alert_project", over("scored", """SELECT window_start, computer, process_key, source, technique_id, scenario,
  risk_score, anomaly_score FROM scored WHERE risk_score >= 0.85"""))
def alert_project(spark, sf):
    return serving.alert_project(V.scored(spark, sf))


@query("feature_json", over("scored", """SELECT window_id, CASE WHEN window_id % 10 <> 0 THEN
  CAST(event_count AS DOUBLE) END AS event_count, CASE WHEN window_id % 10 <> 0 THEN CAST(nullif(unique_files, 0) AS DOUBLE)
  END AS unique_files, CASE WHEN window_id % 10 <> 0 THEN CAST(7 AS DOUBLE) ELSE 1.0 END AS label FROM scored"""))
def feature_json(spark, sf):
    rows = V.scored(spark, sf).select("window_id", "event_count", F.nullif("unique_files", F.lit(0)).alias("unique_files"),
                                      F.lit(7).alias("label"))
    packed = M.pack_features(rows, ("event_count", "unique_files", "label")).withColumn("label", F.lit(1))
    spoiled = packed.withColumn("features_json", F.when(F.col("window_id") % 10 == 0, "{broken")
                                .otherwise(F.col("features_json")))
    names = ("event_count", "unique_files", "label")
    return M.unpack_features(spoiled, names).select("window_id", *names)


@query("pid_from_key", over("windows", r"""SELECT DISTINCT process_key,
  coalesce(TRY_CAST(regexp_extract(process_key || ':' || event_count, ':(\d+)$', 1) AS INTEGER), 9999) AS pid,
  coalesce(TRY_CAST(regexp_extract(process_key, ':(\d+)$', 1) AS INTEGER), 9999) AS key_pid FROM windows"""))
def pid_from_key(spark, sf):
    keyed = F.concat_ws(":", "process_key", F.col("event_count").cast("string"))
    return V.windows(spark, sf).select("process_key", X.pid_from_key(keyed).alias("pid"),
                                       X.pid_from_key(F.col("process_key")).alias("key_pid")).distinct()


@query("alert_to_incident", over("scored", """SELECT 'INC-' || window_id AS id, window_start AS "timestamp", computer,
  technique_id AS ransomware_family, risk_score, event_count::INTEGER AS process_id, 'ACTIVE' AS status
  FROM scored WHERE risk_score >= 0.85"""))
def alert_to_incident(spark, sf):
    alerts = serving.alert_threshold(V.scored(spark, sf)).withColumn(
        "process_key", F.concat_ws(":", F.lit("x.exe"), F.col("event_count").cast("string")))
    incidents = serving.alert_to_incident(alerts, keep=("window_id",))
    return incidents.withColumn("id", serving.incident_label(F.col("window_id"))).drop("window_id")


@query("basename_image", over("wrows", r"""SELECT DISTINCT process_key,
  string_split(process_key, '\')[-1] AS image_name FROM wrows"""))
def basename_image(spark, sf):
    rows = T.windowed_rows(T.event_filter(V.telemetry(spark, sf)))
    return rows.select("process_key", X.basename_image(F.col("process_key")).alias("image_name")).distinct()


@query("activity_flags", over("windows", rf"""SELECT {KEY}, string_split(process_key, '\')[-1] AS image_name,
  file_activity_count > 0 AS has_file, registry_activity_count > 0 AS has_registry,
  network_activity_count > 0 AS has_network, event_1_count > 0 AS has_process FROM windows"""))
def activity_flags(spark, sf):
    return serving.activity_flags(V.windows(spark, sf))


# ---- filters -----------------------------------------------------------------------------------

@query("event_filter", over("filt", "SELECT row_id, event_id, process_guid, process_id FROM filt"))
def event_filter(spark, sf):
    return T.event_filter(V.telemetry(spark, sf)).select("row_id", "event_id", "process_guid", "process_id")


@query("alert_threshold", over("scored", "SELECT window_id, risk_score FROM scored WHERE risk_score >= 0.85"))
def alert_threshold(spark, sf):
    return serving.alert_threshold(V.scored(spark, sf)).select("window_id", "risk_score")


@query("benign_gate", over("scored", f"""SELECT window_id, technique_id, lower(technique_id) IN
  {BENIGN_TECHNIQUES} AS gated FROM scored"""))
def benign_gate(spark, sf):
    return V.scored(spark, sf).select("window_id", "technique_id",
                                      X.benign_technique(F.col("technique_id")).alias("gated"))


@query("low_activity_gate", over("scored", f"""SELECT window_id, CASE WHEN
  lower(technique_id) IN {BENIGN_TECHNIQUES} OR
  (event_count * 4 < 15 AND file_activity_count < 3 AND registry_activity_count < 3) THEN 0.0 ELSE risk_score END
  AS risk_score FROM scored"""))
def low_activity_gate(spark, sf):
    busy = V.scored(spark, sf).withColumn("event_count", F.col("event_count") * 4)
    return serving.gate_scores(busy).select("window_id", "risk_score")


@query("contains_search", over("scored", """SELECT window_id, computer, technique_id FROM scored
  WHERE contains(lower(computer), 'ost-3') AND contains(lower(technique_id), 't1')"""))
def contains_search(spark, sf):
    found = serving.search(V.scored(spark, sf), {"computer": "OST-3", "technique_id": "t1", "scenario": ""})
    return found.select("window_id", "computer", "technique_id")


@query("ilike_escaped", over("wrows", r"""SELECT row_id, command_line, process_key FROM wrows
  WHERE process_key ILIKE '%C:\\bin\\%' ESCAPE '\' OR command_line ILIKE '%\%%' ESCAPE '\'"""))
def ilike_escaped(spark, sf):
    rows = T.windowed_rows(T.event_filter(V.telemetry(spark, sf)))
    found = rows.filter(X.ilike_escaped(F.col("process_key"), "c:\\BIN\\") | X.ilike_escaped(F.col("command_line"), "%"))
    return found.select("row_id", "command_line", "process_key")


@query("min_risk_filter", over("scored", "SELECT window_id, risk_score FROM scored WHERE risk_score >= 0.4"))
def min_risk_filter(spark, sf):
    return serving.min_risk(serving.min_risk(V.scored(spark, sf), "0.4"), "high").select("window_id", "risk_score")


# ---- scalar helpers ----------------------------------------------------------------------------

@query("normalize_path", over("tel", r"SELECT row_id, lower(replace(target_filename, '/', '\')) AS path FROM tel"))
def normalize_path(spark, sf):
    return V.telemetry(spark, sf).select("row_id", X.normalize_path(F.col("target_filename")).alias("path"))


@query("is_suspicious_path", over("tel", r"""SELECT row_id, CASE WHEN k % 4 IN (1, 2) THEN 1 ELSE 0 END AS suspicious
  FROM tel"""))
def is_suspicious_path(spark, sf):
    return V.telemetry(spark, sf).select("row_id", X.is_suspicious_path(F.col("target_filename")).alias("suspicious"))


@query("file_extension", over("tel", r"""SELECT row_id, CASE k % 4 WHEN 1 THEN 'dat' WHEN 2 THEN event_type ELSE '' END
  AS extension FROM tel"""))
def file_extension(spark, sf):
    return V.telemetry(spark, sf).select("row_id", X.file_extension(F.col("target_filename")).alias("extension"))


@query("short_extension", over("tel", r"""SELECT row_id, CASE k % 4 WHEN 1 THEN 'dat' WHEN 2 THEN substring(event_type, 1, 4)
  END AS extension FROM tel"""))
def short_extension(spark, sf):
    return V.telemetry(spark, sf).select("row_id", X.short_extension(F.col("target_filename")).alias("extension"))


@query("keyword_hit", over("tel", "SELECT row_id, k % 3 <> 2 AS hit FROM tel"))
def keyword_hit(spark, sf):
    return V.telemetry(spark, sf).select("row_id", X.keyword_hit(F.col("command_line")).alias("hit"))


@query("time_floor", """SELECT event_id AS row_id, TIMESTAMP '1970-01-01' + to_seconds(epoch_us(ts) // 5000000 * 5) AS floor_5s,
  TIMESTAMP '1970-01-01' + to_seconds(epoch_us(ts) // 7000000 * 7) AS floor_7s FROM events""")
def time_floor(spark, sf):
    return V.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), X.time_floor(F.col("ts"), 5).alias("floor_5s"),
                                               X.time_floor(F.col("ts"), 7).alias("floor_7s"))


@query("escape_like", over("tel", r"""SELECT row_id, replace(replace(replace(
  target_filename || '_100%', '\', '\\'), '%', '\%'), '_', '\_') AS pattern FROM tel"""))
def escape_like(spark, sf):
    value = F.concat("target_filename", F.lit("_100%"))
    return V.telemetry(spark, sf).select("row_id", X.escape_like(value).alias("pattern"))


@query("seconds_between", """SELECT event_id AS row_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) / 1e6
  AS seconds FROM events""")
def seconds_between(spark, sf):
    mark = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    return V.table(spark, sf, "events").select(F.col("event_id").alias("row_id"),
                                               X.seconds_between(F.col("ts"), mark).alias("seconds"))


@query("first_truthy", over("tel", """SELECT row_id, coalesce(nullif(process_guid, ''), nullif(process_id, ''),
  nullif(target_filename, '')) AS key FROM tel"""))
def first_truthy(spark, sf):
    picked = X.first_truthy(F.col("process_guid"), F.col("process_id"), F.col("target_filename"))
    return V.telemetry(spark, sf).select("row_id", picked.alias("key"))


def hmac_sql(message: str) -> str:
    """DuckDB HMAC-SHA256 of a text expression with the fixture key."""
    block = V.SIGNING_KEY.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in block).hex() for p in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query("hmac_sha256", over("tel", f"SELECT row_id, {hmac_sql('command_line || row_id')} AS sig FROM tel"))
def hmac_sha256(spark, sf):
    message = F.concat("command_line", F.col("row_id").cast("string"))
    return V.telemetry(spark, sf).select("row_id", X.hmac_sha256(message, V.SIGNING_KEY).alias("sig"))


@query("round_report", """SELECT event_type, round(avg(value), 4) AS mean_4, round(avg(value), 2) AS mean_2
  FROM events GROUP BY event_type""")
def round_report(spark, sf):
    return V.table(spark, sf, "events").groupBy("event_type").agg(
        F.round(F.avg("value"), 4).alias("mean_4"), F.round(F.avg("value"), 2).alias("mean_2"))


@query("risk_band", over("scored", """SELECT window_id, CASE WHEN risk_score >= 0.85 THEN 'crimson'
  WHEN risk_score >= 0.6 THEN 'amber' ELSE 'mint' END AS band FROM scored"""))
def risk_band(spark, sf):
    return V.scored(spark, sf).select("window_id", X.risk_band(F.col("risk_score")).alias("band"))


@query("display_timestamp", """SELECT event_id AS row_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS shown FROM events""")
def display_timestamp(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return V.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), X.display_timestamp(iso).alias("shown"))


@query("sigmoid_logit", over("scored", """SELECT window_id, round(1 / (1 + exp(-risk_score)), 6) AS probability,
  round(ln((risk_score + 0.5) / 2 / (1 - (risk_score + 0.5) / 2)), 6) AS log_odds FROM scored"""))
def sigmoid_logit(spark, sf):
    risk = F.col("risk_score")
    return V.scored(spark, sf).select("window_id", F.round(X.sigmoid(risk), 6).alias("probability"),
                                      F.round(X.logit((risk + 0.5) / 2), 6).alias("log_odds"))


# ---- listings ----------------------------------------------------------------------------------

NEWEST = 'window_start DESC, computer, process_key'


@query("telemetry_page", over("scored", f"""SELECT {KEY}, risk_score, (SELECT count(*) FROM scored WHERE computer ILIKE '%host-1%')
  AS total FROM scored WHERE computer ILIKE '%host-1%' ORDER BY {NEWEST} LIMIT 50 OFFSET 20"""))
def telemetry_page(spark, sf):
    found = serving.search(V.scored(spark, sf), {"computer": "HOST-1"}, escaped_like=True)
    order = (F.desc("window_start"), F.col("computer"), F.col("process_key"))
    return serving.page(found.select(*WINDOW_KEY, "risk_score"), order, "50", "20")


@query("incident_page", over("scored", """, inc AS (SELECT window_id, computer, risk_score FROM scored WHERE risk_score >= 0.5
  AND contains(lower(scenario), 'scenario-2'))
SELECT *, (SELECT count(*) FROM inc) AS total FROM inc ORDER BY risk_score DESC, window_id LIMIT 1000"""))
def incident_page(spark, sf):
    found = serving.min_risk(serving.search(V.scored(spark, sf), {"scenario": "Scenario-2"}), 0.5)
    ordered = (F.coalesce("risk_score", F.lit(0.0)).desc(), F.col("window_id"))
    return serving.page(found.select("window_id", "computer", "risk_score"), ordered, 5000, -3)


@query("latest_n", over("scored", f"SELECT {KEY}, risk_score FROM scored ORDER BY {NEWEST} LIMIT 40"))
def latest_n(spark, sf):
    return serving.newest(V.scored(spark, sf), serving.MEMORY_ROWS).select(*WINDOW_KEY, "risk_score")


@query("dashboard_kpis", over("scored", f"""
, chart AS (SELECT * FROM scored ORDER BY {NEWEST} LIMIT 30),
smooth AS (SELECT max(risk_score) OVER (ORDER BY window_start, computer DESC, process_key DESC
  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM chart),
recent AS (SELECT * FROM scored ORDER BY {NEWEST} LIMIT 15), a AS (SELECT avg(s) AS m FROM smooth)
SELECT (SELECT count(*) FROM scored) AS total_windows, round(m, 6) AS average_risk,
  CASE WHEN m >= 0.85 THEN 'crimson' WHEN m >= 0.6 THEN 'amber' ELSE 'mint' END AS band,
  (SELECT count(*) FROM recent WHERE anomaly_score > 0 OR risk_score >= 0.5) AS anomalies,
  (SELECT count(*) FROM scored) / 10 AS rate FROM a"""))
def dashboard_kpis(spark, sf):
    return serving.dashboard_kpis(V.scored(spark, sf))


# ---- ordered analytics -------------------------------------------------------------------------

def _ordered(spark, sf, *values: str):
    """Windows with their keys and the columns in use only: the ordering kernel writes and moves what it is given."""
    return V.scored(spark, sf).select("window_id", "computer", "source", "window_start", "process_key", *values)


@query("rolling_max3", over("scored", """SELECT window_id, max(risk_score) OVER (PARTITION BY computer
  ORDER BY window_start, process_key ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smoothed_risk FROM scored"""))
def rolling_max3(spark, sf):
    return serving.rolling_max(_ordered(spark, sf, "risk_score")).select("window_id", "smoothed_risk")


@query("silence_gaps", over("filt", """, g AS (SELECT row_id, computer, "timestamp",
  lag("timestamp") OVER (PARTITION BY computer ORDER BY "timestamp", row_id) AS previous_time FROM filt)
SELECT row_id, previous_time, (epoch_us("timestamp") - epoch_us(previous_time)) / 1e6 AS gap_seconds,
  CASE WHEN epoch_us("timestamp") - epoch_us(previous_time) > 30000000 THEN 'SENSOR_SILENCED' ELSE 'HEALTHY' END AS status
FROM g"""))
def silence_gaps(spark, sf):
    events = T.event_filter(V.telemetry(spark, sf)).select("row_id", "computer", "timestamp")
    return E.silence_gaps(events, ties=("row_id",)).select("row_id", "previous_time", "gap_seconds", "status")


@query("escalation_episodes", over("scored", """
, r AS (SELECT *, sum(CASE WHEN risk_score < 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY computer
  ORDER BY window_start, process_key) AS ep, row_number() OVER (PARTITION BY computer ORDER BY window_start, process_key) AS rn
  FROM scored),
e AS (SELECT computer, ep, max(risk_score) AS peak, min(rn) FILTER (risk_score >= 0.6 AND risk_score < 0.85) AS w,
  min(rn) FILTER (risk_score >= 0.85) AS c FROM r GROUP BY ALL),
i AS (SELECT computer, ep, peak, w AS at_rn, c AS by_rn, 'ACTIVE' AS status FROM e WHERE w < c
  UNION ALL SELECT computer, ep, peak, c, c, 'ACTIVE' FROM e WHERE c IS NOT NULL AND (w IS NULL OR c < w)
  UNION ALL SELECT computer, ep, peak, w, w, 'MONITORING' FROM e WHERE w IS NOT NULL AND (c IS NULL OR c < w))
SELECT i.computer, CAST(i.ep AS BIGINT) AS episode, a.window_start AS opened_at, b.risk_score, i.status, i.peak AS peak_risk
FROM i JOIN r a ON a.computer = i.computer AND a.rn = at_rn JOIN r b ON b.computer = i.computer AND b.rn = by_rn"""))
def escalation_episodes(spark, sf):
    return E.escalation_episodes(_ordered(spark, sf, "risk_score"))


@query("sequence_builder", over("scored", """, s AS (SELECT window_id, label, list(event_count) OVER w AS q, sum(event_count + unique_files)
  OVER w AS total FROM scored WINDOW w AS (PARTITION BY source ORDER BY window_start, process_key, window_id
  ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT window_id, label, CAST(30 AS INTEGER) AS steps, repeat('0,', 30 - len(q)) || array_to_string(q, ',') AS event_counts,
  CAST(total AS BIGINT) AS total FROM s"""))
def sequence_builder(spark, sf):
    built = sequences.sequence_builder(_ordered(spark, sf, "label", "event_count", "unique_files"), ("event_count", "unique_files"),
                                       order=("window_start", "process_key", "window_id"))
    first = F.transform("sequence", lambda v: v[0].cast("long").cast("string"))
    total = F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x).cast("long")
    return built.select("window_id", "label", F.size("sequence").alias("steps"),
                        F.array_join(first, ",").alias("event_counts"), total.alias("total"))


@query("host_history", over("scored", """SELECT window_id, count(*) OVER w AS steps, sum(event_count) OVER w / 30.0 AS mean_event_count,
  CASE WHEN count(*) OVER w < 30 THEN greatest(max(event_count) OVER w, 0) ELSE max(event_count) OVER w END::DOUBLE AS max_event_count
  FROM scored WINDOW w AS (PARTITION BY computer ORDER BY window_start, process_key, window_id
  ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""))
def host_history(spark, sf):
    rows = sequences.seq_pooling(_ordered(spark, sf, "event_count"), ("event_count",), group=("computer",),
                                 order=("window_start", "process_key", "window_id"))
    return rows.select("window_id", "steps", "mean_event_count", "max_event_count")


@query("seq_pooling", over("scored", """SELECT window_id, round(sum(anomaly_score) OVER w / 30, 6) AS mean_anomaly_score,
  CASE WHEN count(*) OVER w < 30 THEN greatest(max(anomaly_score) OVER w, 0.0) ELSE max(anomaly_score) OVER w END AS max_anomaly_score
  FROM scored WINDOW w AS (PARTITION BY source ORDER BY window_start, process_key, window_id
  ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""))
def seq_pooling(spark, sf):
    rows = sequences.seq_pooling(_ordered(spark, sf, "anomaly_score"), ("anomaly_score",), order=("window_start", "process_key", "window_id"))
    return rows.select("window_id", F.round("mean_anomaly_score", 6).alias("mean_anomaly_score"), "max_anomaly_score")


@query("history_asof", over("scored", """, r AS (SELECT *, row_number() OVER (PARTITION BY computer ORDER BY window_start, process_key,
  window_id) AS position FROM scored)
SELECT c.window_id AS current_window_id, h.window_id, c.position - h.position + 1 AS step, h.risk_score
FROM r c JOIN r h ON h.computer = c.computer AND h.position BETWEEN c.position - 29 AND c.position WHERE c.risk_score >= 0.85"""))
def history_asof(spark, sf):
    rows = sequences.history_asof(_ordered(spark, sf, "risk_score"), F.col("risk_score") >= 0.85,
                                  order=("window_start", "process_key", "window_id"))
    return rows.select("current_window_id", "window_id", F.col("step").cast("long").alias("step"), "risk_score")
