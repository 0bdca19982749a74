"""Stream queries run over the given tables until all input is read; results are read back from their sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.risk import BENIGN_TECHNIQUES
from ..operators import models as M
from ..operators import sequence_model as SM
from ..schemas import WINDOW_KEY
from ..session import scratch_path
from ..streaming import live
from . import views as V
from .checks import AGGS, FLOOR, over
from .registry import query

HOUR = 3600


def _telemetry_stream(spark, sf):
    """The telemetry view over a stream of the events file."""
    schema = V.table(spark, sf, "events").schema
    raw = live.event_stream(spark, sf, schema, glob="events.parquet")
    return V.telemetry_of(raw).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _run(stream, label: str):
    """Run a stream to the end and read its table."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    live.append(stream, path, scratch_path(spark, f"{label}-state"), available_now=True,
                state_partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.schema.names)


def _ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("stream_dedupe", over("tel", """SELECT DISTINCT computer, "timestamp", event_id, process_id FROM tel"""))
def stream_dedupe(spark, sf):
    events = _telemetry_stream(spark, sf).select("computer", "timestamp", "event_id", "process_id")
    return _ntz(_run(live.stream_dedupe(events.union(events), "1 hour"), "dedupe"), "timestamp")


# A window is final once the watermark (newest event minus the delay, in milliseconds) has passed its end.
CLOSED = """(SELECT time_bucket(INTERVAL 1 MILLISECOND, max("timestamp")) - INTERVAL {delay} FROM {view})"""


@query("stream_process_windows", over("wrows", f""", h AS (SELECT computer, process_key, {FLOOR.format(ts='"timestamp"', n=HOUR)} AS window_start,
  {AGGS} FROM wrows GROUP BY ALL)
SELECT * FROM h WHERE window_start + INTERVAL 1 HOUR <= {CLOSED.format(delay='1 HOUR', view='tel')}"""))
def stream_process_windows(spark, sf):
    windows = live.stream_process_windows(_telemetry_stream(spark, sf), "1 hour", HOUR)
    return _ntz(_run(windows, "windows"), "window_start")


@query("late_data", over("filt", """SELECT computer, count(*) FILTER ("timestamp" >= TIMESTAMP '2024-01-15' AND "timestamp" < date_trunc('hour',
  (SELECT time_bucket(INTERVAL 1 MILLISECOND, max("timestamp")) - INTERVAL 1 HOUR FROM tel))) AS events,
  (SELECT count(*) FROM tel WHERE "timestamp" < TIMESTAMP '2024-01-15') AS late_rows FROM filt GROUP BY computer"""))
def late_data(spark, sf):
    """The newer half of the events first, in two runs of the stream, then the older half: all of it comes behind the watermark."""
    events = V.table(spark, sf, "events")
    marks = [F.lit(d).cast("timestamp_ntz") for d in ("2024-01-15", "2024-01-22")]
    folder, path, state = (scratch_path(spark, n) for n in ("late", "late-windows", "late-state"))
    late = 0
    for part in ((F.col("ts") >= marks[0]) & (F.col("ts") < marks[1]), F.col("ts") >= marks[1], F.col("ts") < marks[0]):
        events.filter(part).write.mode("append").parquet(folder)
        raw = live.event_stream(spark, folder, events.schema)
        rows = V.telemetry_of(raw).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        run = live.append(live.stream_process_windows(rows, "1 hour", HOUR), path, state, available_now=True,
                          state_partitions=spark.sparkContext.defaultParallelism)
        counter = live.LateRows(run)
        run.awaitTermination()
        late += counter.total()
    emitted = spark.read.schema("computer string, event_count bigint").parquet(path)
    return emitted.groupBy("computer").agg(F.sum("event_count").alias("events"), F.lit(late).cast("long").alias("late_rows"))


@query("stream_heartbeat", over("tel", f"""
, seen AS (SELECT computer, "timestamp" AS ts FROM tel WHERE date_trunc('second', "timestamp") + INTERVAL 1 SECOND <= {CLOSED.format(delay='10 SECONDS', view='tel')}),
s AS (SELECT *, lead(ts) OVER w AS resumed_at, count(*) OVER w AS total_events FROM seen WINDOW w AS (PARTITION BY computer ORDER BY ts)),
g AS (SELECT * FROM s WHERE resumed_at IS NULL AND ts + INTERVAL 30.001 SECONDS <= {CLOSED.format(delay='10 SECONDS', view='tel')}
  OR epoch_us(resumed_at) - epoch_us(ts) > 30000000)
SELECT computer, ts AS last_event, resumed_at, (epoch_us(resumed_at) - epoch_us(ts)) / 1e6 AS gap_seconds, total_events,
  CASE WHEN resumed_at IS NULL THEN 'SENSOR_SILENCED' ELSE 'HEALTHY' END AS status FROM g"""))
def stream_heartbeat(spark, sf):
    beats = live.stream_heartbeat(_telemetry_stream(spark, sf), "10 seconds")
    return _ntz(_run(beats, "heartbeat"), "last_event", "resumed_at")


def _window_stream(spark, sf):
    """Scored windows written as a table and read as a stream."""
    path = scratch_path(spark, "scored-windows")
    scored = V.scored(spark, sf)
    scored.write.parquet(path)
    return live.event_stream(spark, path, scored.schema)


LIVE_FEATURES = ("event_count", "unique_files")
LIVE_MODEL = SM.SequenceModel(M.Scaler(LIVE_FEATURES, (2.0, 1.0), (1.5, 1.0)), (0.5, 0.2), (0.6, 0.4), -0.9)
LIVE = """, z AS (SELECT *, (event_count - 2.0) / 1.5 AS a, (unique_files - 1.0) AS b FROM scored),
h AS (SELECT *, sum(a) OVER w / 30 AS ma, sum(b) OVER w / 30 AS mb, CASE WHEN count(*) OVER w < 30 THEN greatest(max(a) OVER w, 0) ELSE max(a) OVER w END AS xa,
  CASE WHEN count(*) OVER w < 30 THEN greatest(max(b) OVER w, 0) ELSE max(b) OVER w END AS xb FROM z
  WINDOW w AS (PARTITION BY computer ORDER BY window_start, process_key ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, CASE WHEN lower(technique_id) IN {BENIGN}
    OR (event_count < 15 AND file_activity_count < 3 AND registry_activity_count < 3) THEN 0.0
  ELSE 1 / (1 + exp(-(-0.9 + 0.5 * ma + 0.6 * xa + 0.2 * mb + 0.4 * xb))) END AS risk FROM h)
""".replace("{BENIGN}", str(BENIGN_TECHNIQUES))


def _alerts(spark, sf):
    return live.stream_alerts(_window_stream(spark, sf), LIVE_MODEL, 0.85)


@query("stream_alerts", over("scored", LIVE + """SELECT computer, process_key, window_start, round(risk, 6) AS risk_score, risk >= 0.85
  AND row_number() OVER (PARTITION BY computer, window_start, risk >= 0.85 ORDER BY process_key) = 1 AS alert_created FROM r"""))
def stream_alerts(spark, sf):
    scored = _ntz(_run(_alerts(spark, sf), "alerts"), "window_start")
    return scored.select("computer", "process_key", "window_start", F.round("risk_score", 6).alias("risk_score"), "alert_created")


@query("stream_incidents", over("scored", LIVE + """SELECT window_start AS "timestamp", computer, min_by(technique_id, process_key) AS ransomware_family,
  round(min_by(risk, process_key), 6) AS risk_score, 'ACTIVE' AS status FROM r WHERE risk >= 0.85 GROUP BY window_start, computer"""))
def stream_incidents(spark, sf):
    incidents = live.incidents_of(_alerts(spark, sf))
    rows = _ntz(_run(incidents, "incidents"), "timestamp").withColumn("risk_score", F.round("risk_score", 6))
    return rows.select("timestamp", "computer", "ransomware_family", "risk_score", "status")


@query("alert_handoff", over("scored", """, a AS (SELECT * FROM scored WHERE risk_score >= 0.5 AND window_start >= TIMESTAMP '2024-01-05'),
b AS (SELECT *, row_number() OVER (PARTITION BY computer, window_start ORDER BY risk_score DESC, process_key || ':' || event_count DESC) AS rn FROM a)
SELECT window_start AS alert_id, computer, risk_score, CASE WHEN risk_score >= 0.85 THEN event_count::INTEGER END AS process_id,
  risk_score >= 0.85 AS terminate_tree, risk_score >= 0.85 AS isolate_host, 'dry_run' AS mode FROM b WHERE rn = 1"""))
def alert_handoff(spark, sf):
    """Alerts before the fifth day were there at the start."""
    keyed = F.concat_ws(":", "process_key", F.col("event_count").cast("string"))
    alerts = (_window_stream(spark, sf).filter("risk_score >= 0.5").withColumn("process_key", keyed)
              .select("computer", "process_key", F.col("window_start").cast("timestamp").alias("window_start"), "risk_score"))
    old = (V.scored(spark, sf).filter(F.col("window_start") < F.lit("2024-01-05").cast("timestamp_ntz"))
           .select(F.col("window_start").cast("timestamp").alias("alert_id"), "computer").distinct())
    return _ntz(_run(live.alert_handoff(alerts, old), "intents"), "alert_id")


@query("stream_escalation", over("scored", """
, r AS (SELECT *, sum(CASE WHEN risk_score < 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY computer
  ORDER BY window_start, process_key) AS ep, row_number() OVER (PARTITION BY computer ORDER BY window_start, process_key) AS rn FROM scored),
e AS (SELECT computer, ep, min(rn) FILTER (risk_score >= 0.6 AND risk_score < 0.85) AS w, min(rn) FILTER (risk_score >= 0.85) AS c FROM r GROUP BY ALL),
i AS (SELECT computer, ep, 'OPENED' AS change, w AS o, w AS a, 'MONITORING' AS status FROM e WHERE w IS NOT NULL
  UNION ALL SELECT computer, ep, 'UPGRADED', w, c, 'ACTIVE' FROM e WHERE w < c
  UNION ALL SELECT computer, ep, 'OPENED', c, c, 'ACTIVE' FROM e WHERE c IS NOT NULL AND (w IS NULL OR c < w))
SELECT i.computer, CAST(i.ep AS BIGINT) AS episode, change, x.window_start AS opened_at, y.window_start AS changed_at, y.risk_score, i.status
FROM i JOIN r x ON x.computer = i.computer AND x.rn = o JOIN r y ON y.computer = i.computer AND y.rn = a"""))
def stream_escalation(spark, sf):
    return _ntz(_run(live.stream_escalation(_window_stream(spark, sf)), "escalation"), "opened_at", "changed_at")
