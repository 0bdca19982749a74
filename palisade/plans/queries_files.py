"""Queries on file formats. Spark first writes the given tables in the format, then the source reads it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts
from ..operators import telemetry as T
from ..schemas import WINDOW_FEATURES, WINDOW_KEY
from ..session import durable, scratch_path
from ..sources import alerts as A
from ..sources import files, pages, reports, snapshots, xml_events
from ..operators import serving
from . import views as V
from .checks import over
from .queries_telemetry import hmac_sql
from .registry import query

WINDOW_DDL = ("computer STRING, process_key STRING, window_start TIMESTAMP_NTZ, "
              + ", ".join(f"{f} BIGINT" for f in WINDOW_FEATURES))


def _xml_log(spark, sf) -> str:
    """Events as a root-less XML log; the malformed id becomes an unsupported one."""
    events = V.telemetry(spark, sf)

    def data(name: str, value):
        return F.concat(F.lit(f"<Data Name='{name}'>"), F.coalesce(value, F.lit("")), F.lit("</Data>"))
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    event_id = F.when(F.col("event_id") == "bad", "99").otherwise(F.col("event_id"))
    xml = F.concat(
        F.lit("<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><Provider Name='P'/><EventID>"),
        event_id, F.lit("</EventID><TimeCreated SystemTime='"), stamp, F.lit("'/><Computer>"), F.col("computer"),
        F.lit("</Computer></System><EventData>"),
        data("UtcTime", F.when(F.col("k") % 2 == 0, stamp)), data("RowId", F.col("row_id").cast("string")),
        F.when(F.col("k") % 3 == 0, data("SourceProcessGUID", F.col("process_guid"))).otherwise(data("ProcessGuid", F.col("process_guid"))),
        data("ProcessId", F.col("process_id")), data("Image", F.col("image")),
        data("CommandLine", F.concat("command_line", F.lit(" &amp; exit"))), data("TargetFilename", F.col("target_filename")),
        data("DestinationIp", F.col("destination_ip")), F.lit("</EventData></Event>"))
    path = scratch_path(spark, "xml")
    events.select(xml.alias("value")).write.text(path)
    return path


@query("xml_event_scan", over("tel", "SELECT row_id, 1 AS documents FROM tel"))
def xml_event_scan(spark, sf):
    documents = xml_events.xml_event_scan(spark, _xml_log(spark, sf), "*.txt")
    row = F.regexp_extract("xml", "<Data Name='RowId'>([0-9]+)</Data>", 1).cast("long")
    complete = F.when(F.col("xml").startswith("<Event xmlns") & F.col("xml").endswith("</EventData></Event>"), 1)
    return documents.select(row.alias("row_id"), complete.alias("documents"))


@query("xml_event_parse", over("tel", """SELECT row_id, CASE event_id WHEN 'bad' THEN 99 ELSE CAST(event_id AS INTEGER) END AS event_id,
  "timestamp", computer, nullif(process_guid, '') AS process_guid, nullif(process_id, '') AS process_id, image,
  command_line || ' & exit' AS command_line, nullif(target_filename, '') AS target_filename,
  nullif(destination_ip, '') AS destination_ip, CAST(8 AS INTEGER) AS extras FROM tel""").replace("CASE event_id WHEN 'bad' THEN 99 ELSE CAST(event_id AS INTEGER) END",
                                                                              "coalesce(TRY_CAST(event_id AS INTEGER), 99)"))
def xml_event_parse(spark, sf):
    events = xml_events.xml_event_parse(xml_events.xml_event_scan(spark, _xml_log(spark, sf), "*.txt"))
    return events.select(F.col("extra")["RowId"].cast("long").alias("row_id"), "event_id",
                         F.try_to_timestamp("timestamp").cast("timestamp_ntz").alias("timestamp"), "computer", "process_guid",
                         "process_id", "image", "command_line", "target_filename", "destination_ip",
                         F.size("extra").alias("extras"))


@query("xml_to_windows", over("windows", "SELECT * FROM windows"))
def xml_to_windows(spark, sf):
    """Log files to windows in one plan: scan, parse, filter, aggregate."""
    events = xml_events.xml_event_parse(xml_events.xml_event_scan(spark, _xml_log(spark, sf), "*.txt"))
    windows = T.process_windows(T.event_filter(events), V.DAY)
    return windows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("source_discovery", over("tel", """SELECT DISTINCT 'technique_id=' || technique_id AS technique_id, 'scenario=' || scenario AS scenario FROM tel"""))
def source_discovery(spark, sf):
    root = scratch_path(spark, "attack_logs") + "/attack_techniques"
    events = V.telemetry(spark, sf).select("technique_id", "scenario", F.concat_ws(" ", "computer", "event_id").alias("value"))
    events.repartition("technique_id", "scenario").write.partitionBy("technique_id", "scenario").text(root)
    return files.source_discovery(spark, root, "*.txt").select("technique_id", "scenario").distinct()


@query("csv_scan", over("windows", "SELECT * FROM windows"))
def csv_scan(spark, sf):
    return files.csv_scan(spark, files.csv_sink(V.windows(spark, sf), scratch_path(spark, "csv")), WINDOW_DDL)


@query("csv_sink", over("windows", "SELECT computer, count(*) AS windows, CAST(sum(event_count) AS BIGINT) AS events FROM windows GROUP BY computer"))
def csv_sink(spark, sf):
    path = files.csv_sink(V.windows(spark, sf), scratch_path(spark, "csv"))
    back = files.csv_scan(spark, path, WINDOW_DDL)
    return back.groupBy("computer").agg(F.count(F.lit(1)).alias("windows"), F.sum("event_count").alias("events"))


@query("chunked_filter_scan", """SELECT o_orderkey AS sample_id, o_totalprice AS size, 'good' AS ware_type FROM orders WHERE o_orderstatus = 'F'""")
def chunked_filter_scan(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("size"),
                                                 F.when(F.col("o_orderstatus") == "F", "good").otherwise("bad").alias("ware_type"))
    path = files.csv_sink(orders, scratch_path(spark, "ware"))
    return files.csv_scan(spark, path, "sample_id BIGINT, size DOUBLE, ware_type STRING").filter("ware_type = 'good'")


CALLS = {"click": "NtOpen", "error": "NtWrite", "purchase": "NtCreate", "signup": "NtQuery", "view": "NtRead"}  # a call name for each type of event


@query("delimited_counts_scan", "SELECT user_id AS process, " + ", ".join(
    f"count(*) FILTER (event_type = '{kind}') AS {call}" for kind, call in CALLS.items()) + " FROM events GROUP BY user_id")
def delimited_counts_scan(spark, sf):
    calls = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("process")).agg(
        *(F.count_if(F.col("event_type") == kind).alias(call) for kind, call in CALLS.items()))
    path = files.csv_sink(calls, scratch_path(spark, "calls"), sep=";")
    return files.csv_scan(spark, path, "process BIGINT, " + ", ".join(f"{call} BIGINT" for call in CALLS.values()), sep=";")


@query("report_json_scan", over("tel", """SELECT row_id AS sample_id, k / 10 AS score, CAST(3 AS INTEGER) AS strings, 'Sig_' || event_type AS signature,
  FALSE AS malformed FROM tel WHERE k % 9 <> 0 UNION ALL SELECT NULL, NULL, NULL, NULL, TRUE FROM tel WHERE k % 9 = 0"""))
def report_json_scan(spark, sf):
    path = scratch_path(spark, "reports")
    text = F.to_json(F.struct(*(c for c in V.reports(spark, sf).columns)))
    spoiled = F.when(F.round(F.col("info.score") * 10).cast("int") % 9 == 0, F.substring(text, 1, 40)).otherwise(text)
    V.reports(spark, sf).select(spoiled.alias("value")).write.text(path)
    rows = reports.report_json_scan(spark, path, one_per_file=False)
    told = {"sample_id": F.col("sample_id"), "score": F.col("info.score"), "strings": F.size("strings"), "signature": F.col("signatures")[0]["name"]}
    good = F.col(reports.CORRUPT).isNull()  # good and bad in one pass over the files
    return rows.select(*(F.when(good, value).alias(name) for name, value in told.items()), (~good).alias("malformed"))


@query("parquet_scan_sink", over("windows", "SELECT * FROM windows WHERE computer = 'host-2' AND event_count > 1"))
def parquet_scan_sink(spark, sf):
    path = files.parquet_sink(V.windows(spark, sf), scratch_path(spark, "windows"), ("computer",))
    return spark.read.parquet(path).filter("computer = 'host-2' AND event_count > 1")


ARRAY_ROWS = 5000


@query("json_to_jsonl", "SELECT event_id AS row_id, event_type, user_id FROM events")
def json_to_jsonl(spark, sf):
    """Events as JSON array files of a fixed number of rows, converted to JSON lines."""
    events = V.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "event_type", "user_id")
    chunks = counts.chunk_index(events, ("row_id",), ARRAY_ROWS)
    arrays = chunks.groupBy("chunk").agg(F.to_json(F.collect_list(F.struct("row_id", "event_type", "user_id"))).alias("value"))
    source = scratch_path(spark, "arrays")
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(source)
    lines = files.json_to_jsonl(spark, source, scratch_path(spark, "lines"), "row_id BIGINT, event_type STRING, user_id BIGINT")
    return lines


@query("binary_hash_scan", """WITH f AS (SELECT doc_id // 20 AS bundle, string_agg(replace(text, chr(10), ' ') || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY 1)
SELECT bundle, sha256(content) AS sha256, sha1(content) AS sha1, md5(content) AS md5 FROM f""")
def binary_hash_scan(spark, sf):
    """The documents as files of twenty lines at most, and the hash of each file."""
    bundle = F.floor(F.col("doc_id") / 20)
    lines = V.table(spark, sf, "documents").select(bundle.alias("bundle"), "doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    path = scratch_path(spark, "files")
    lines.repartition("bundle").sortWithinPartitions("bundle", "doc_id").drop("doc_id").write.partitionBy("bundle").text(path)
    return files.binary_hashes(spark, f"{path}/*").select(F.col("bundle").cast("long").alias("bundle"), "sha256", "sha1", "md5")


@query("log_error_screen", over("tel", """SELECT DISTINCT user_id AS run_id FROM tel WHERE user_id NOT IN
  (SELECT user_id FROM tel WHERE event_type = 'error' AND k % 20 = 7)"""))
def log_error_screen(spark, sf):
    events = V.telemetry(spark, sf)
    noisy = F.col("event_type") == "error"
    line = (F.when(noisy & (F.col("k") % 20 == 7), F.concat(F.lit("2024 ERROR: run "), "row_id"))
            .when(noisy & (F.col("k") % 2 == 0), "WARNING: Error closing handle")
            .when(noisy, "Error dumping file from path x").otherwise(F.concat(F.lit("terrors of "), "row_id")))
    logged = events.select(F.col("user_id").alias("run_id"), line.alias("value"))
    path = scratch_path(spark, "logs")
    logged.select(F.concat_ws("\t", "run_id", "value").alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.split("value", "\t")[0].cast("long").alias("run_id"), F.split("value", "\t")[1].alias("value"))
    return files.log_error_screen(logged.select("run_id").distinct(), lines)


PAYLOAD = """'{"computer":"' || computer || '","process_key":"' || replace(process_key, '\\', '\\\\') || '","risk_score":' || risk_score
  || ',"scenario":"' || scenario || '","source":"' || source || '","technique_id":"' || technique_id || '","window_start":"'
  || strftime(window_start, '%Y-%m-%dT%H:%M:%SZ') || '"}'"""


def _alert_rows(spark, sf):
    alerts = serving.alert_project(V.scored(spark, sf)).drop("anomaly_score")
    return alerts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


@query("signed_alert_sink", over("scored", f""", p AS (SELECT {PAYLOAD} AS payload FROM scored WHERE risk_score >= 0.85),
n AS (SELECT row_number() OVER (ORDER BY payload) AS seq, payload FROM p)
SELECT seq, payload, {hmac_sql("'daily|' || seq || '|' || payload")} AS sig, TRUE AS verified FROM n"""))
def signed_alert_sink(spark, sf):
    path = A.write_alerts(_alert_rows(spark, sf), scratch_path(spark, "alerts"), V.SIGNING_KEY, "daily")
    return A.check_signatures(spark.read.schema(A.ROW).json(path), V.SIGNING_KEY, "daily")


@query("verified_alert_scan", over("scored", """SELECT computer, process_key, risk_score, strftime(window_start, '%Y-%m-%dT%H:%M:%SZ') AS window_start
  FROM scored WHERE risk_score >= 0.85"""))
def verified_alert_scan(spark, sf):
    path = A.write_alerts(_alert_rows(spark, sf), scratch_path(spark, "alerts"), V.SIGNING_KEY)
    return A.read_alerts(spark, path, V.SIGNING_KEY, "computer STRING, process_key STRING, risk_score DOUBLE, window_start STRING")


@query("table_refresh", over("scored", """SELECT 'feature_vectors' AS name, count(*) AS rows, CAST(sum(event_count) AS BIGINT) AS total,
  CAST(sum(event_count) FILTER (window_id % 2 = 0) AS BIGINT) AS total_before, CAST(2 AS BIGINT) AS version FROM scored
  UNION ALL SELECT 'incidents', count(*), CAST(count(*) * 9999 AS BIGINT), CAST(count(*) FILTER (window_id % 2 = 0) * 9999 AS BIGINT), 2 FROM scored WHERE risk_score >= 0.85"""))
def table_refresh(spark, sf):
    """Make the window and incident tables from half the windows, then from all; a reader that began before the refresh still sees the first rows."""
    scored = durable(V.scored(spark, sf))
    out = []
    for name, value in (("feature_vectors", "event_count"), ("incidents", "process_id")):
        root = scratch_path(spark, name)
        for version, rows in enumerate((scored.filter("window_id % 2 = 0"), scored), 1):
            if name == "incidents":
                rows = serving.alert_to_incident(serving.alert_threshold(rows).withColumn("process_key", F.lit("k")))
            number = snapshots.publish(rows, root)
            if version == 1:
                before = snapshots.read_snapshot(spark, root)
        now = snapshots.read_snapshot(spark, root)
        out.append(now.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))
                   .crossJoin(before.agg(F.sum(value).alias("total_before"))).withColumn("version", F.lit(number).cast("long")))  # one row each
    return out[0].unionByName(out[1])


@query("table_upsert", over("scored", """SELECT computer, process_key, window_start, CAST(max(event_count) AS BIGINT) + CASE WHEN max(window_id) % 3 = 0 THEN 1000 ELSE 0 END AS event_count,
  CAST(3 AS BIGINT) AS versions FROM scored GROUP BY ALL"""))
def table_upsert(spark, sf):
    """Two of three windows are stored, the last third with changed counts is merged by key, twice."""
    keys = ("computer", "process_key", "window_start")
    rows = V.scored(spark, sf).groupBy(*keys).agg(F.max("event_count").cast("long").alias("event_count"), F.max("window_id").alias("w"))
    rows = durable(rows)
    root = scratch_path(spark, "merged")
    snapshots.publish(rows.filter("w % 3 <> 0 OR w % 2 = 0").drop("w"), root)
    late = rows.filter("w % 3 = 0").select(*keys, (F.col("event_count") + 1000).alias("event_count"))
    for _ in range(2):
        number = snapshots.upsert(late, root, keys)
    return snapshots.read_snapshot(spark, root).withColumn("versions", F.lit(number).cast("long"))


LISTING = """listing AS (SELECT page_id, replace(CASE WHEN page_id % 2 = 0 THEN replace(html, '</a>', '</a><div class="description"> about <b>' || page_id || '</b></div>')
  ELSE html END, '<a href="', '<a class="link_ttl" href="') AS html FROM pages),
piece AS (SELECT page_id, unnest(list_zip(range(len(p) - 1), p[2:])) AS z FROM (SELECT page_id, string_split(html, '<a class="link_ttl"') AS p FROM listing)),
parts AS (SELECT page_id, z[1] AS i, z[2] AS x FROM piece)"""


@query("page_metadata_extract", f"""WITH {LISTING}
SELECT page_id, CAST(i AS INTEGER) AS position, regexp_extract(x, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(x, '(?s)^[^>]*>(.*?)</a>', 1), '<[^>]+>', '', 'g')) AS title,
  coalesce(nullif(trim(regexp_replace(regexp_extract(x, '(?s)<div[^>]*class="description"[^>]*>(.*?)</div>', 1), '<[^>]+>', '', 'g')), ''),
    nullif(trim(regexp_replace(regexp_extract(x, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1), '<[^>]+>', '', 'g')), ''), 'No description available') AS description FROM parts""")
def page_metadata_extract(spark, sf):
    """The given pages as listings: their links get the listing's class, every second page descriptions."""
    described = F.replace("html", F.lit("</a>"), F.concat(F.lit('</a><div class="description"> about <b>'), "page_id", F.lit("</b></div>")))
    html = F.replace(F.when(F.col("page_id") % 2 == 0, described).otherwise(F.col("html")), F.lit('<a href="'), F.lit('<a class="link_ttl" href="'))
    return pages.app_links(V.table(spark, sf, "pages").withColumn("html", html))


@query("page_file_details", """SELECT page_id, 'setup' || page_id || '.exe' AS file_name, length(html) || ' KB' AS file_size, md5(url) AS md5,
  '2024-01-0' || (page_id % 9 + 1) AS last_checked, url || '/get' AS download_link FROM pages WHERE page_id % 3 <> 0""")
def page_file_details(spark, sf):
    """Two of three pages link to a report page of their own, which is a row of the same table."""
    page, url = F.col("page_id"), F.col("url")
    report = F.concat(F.lit("http://report/"), page)
    block = F.concat(F.lit('<p class="file_info"><span>File: setup'), page, F.lit(".exe</span><span>Size: "), F.length("html"),
                     F.lit(" KB</span><span>MD5: "), F.md5(url.cast("binary")), F.lit("</span> <span>Checked: 2024-01-0"),
                     page % 9 + 1, F.lit("</span></p>"))
    link = F.concat(F.lit('<a rel="x" href="'), report, F.lit('"> see the report </a><a class="download_btn" href="'), url, F.lit('/get">get</a>'))
    given = V.table(spark, sf, "pages").select("page_id", "url", "html")
    apps = given.withColumn("html", F.when(page % 3 != 0, F.concat("html", link)).otherwise(F.col("html")))
    told = given.select((-page).alias("page_id"), report.alias("url"), block.alias("html"))
    return pages.application_details(apps.unionByName(told))


@query("av_report_project", over("tel", """SELECT row_id, k::BIGINT AS creation_date, CASE WHEN k % 2 = 0 THEN user_id END AS first_submission_date,
  md5('' || row_id) AS md5, NULL::VARCHAR AS sha1, sha256('' || row_id) AS sha256, 'exe' AS type_extension, k::BIGINT AS malicious,
  (k + user_id % 10 + 3)::BIGINT AS total_avi_tested, CASE WHEN k % 3 = 0 THEN 'Fam' || k WHEN k % 3 = 1 THEN NULL END AS malware_names,
  CASE WHEN k % 3 = 0 THEN 'RANSOM' END AS malware_classification FROM tel"""))
def av_report_project(spark, sf):
    k, uid, row = F.col("k"), F.col("user_id"), F.col("row_id").cast("string").cast("binary")
    none = F.array().cast("array<string>")
    verdict = F.struct(F.when(k % 3 == 0, F.array(F.concat(F.lit("Fam"), k), F.lit("Other"))).otherwise(none).alias("malware_names"),
                       F.when(k % 3 == 0, F.array(F.lit("RANSOM"))).alias("malware_classification"))
    attributes = F.struct(
        k.cast("long").alias("creation_date"), F.when(k % 2 == 0, uid).alias("first_submission_date"),
        F.create_map(F.lit("malicious"), k.cast("long"), F.lit("harmless"), uid % 10, F.lit("undetected"), F.lit(3).cast("long")).alias("last_analysis_stats"),
        F.md5(row).alias("md5"), F.sha2(row, 256).alias("sha256"), F.lit("exe").alias("type_extension"),
        F.when(k % 3 != 2, F.create_map(F.lit("C2AE"), verdict)).alias("sandbox_verdicts"))
    rows = V.telemetry(spark, sf).select("row_id", F.to_json(F.struct(attributes.alias("attributes"))).alias("report"))
    return reports.av_report_project(rows, keep=("row_id",))
