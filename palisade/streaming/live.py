"""Live twins of the batch jobs: windows, heartbeat, alerts, hand-off and escalation.

Every query reads a stream of rows, keeps bounded state and appends final rows. Windows and heartbeats keep theirs behind a watermark,
alerts, hand-off and escalation a few rows a host (``ordered``), which expire where they would grow.
Distinct counts are exact and spread by value: each event becomes a few (kind, value) facts, facts are
made distinct per window, and the last step only adds them up.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import benign_technique, low_activity, pid_from_key, sigmoid
from ..operators.episodes import decisive, episode_firsts
from ..operators.ordering import trailing
from ..operators.sequence_model import SequenceModel
from ..operators.telemetry import event_filter, window_facts, window_totals, windowed_rows
from ..schemas import ALERT_THRESHOLD, SILENCE_SECONDS, WINDOW_SECONDS
from ..session import durable
from .ordered import OrderedJob, State

#: What tells events apart: the host's record number where there is one, else the host and all that is known of the event.
RECORD_KEY = ("computer", "record_id")
EVENT_KEY = ("computer", "timestamp", "event_id", "process_guid", "process_id", "image", "parent_image", "command_line", "target_filename", "target_object",
             "destination_ip", "destination_port")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they arrive."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def append(stream: DataFrame | OrderedJob, path: str, checkpoint: str, available_now: bool = False,
           state_partitions: int | None = None) -> StreamingQuery:
    """Write final rows as Parquet with exactly-once file commits.

    The number of state partitions is fixed by the first start of a checkpoint, so choose it for the cluster
    (default: the session's shuffle partitions). The query keeps the settings it was started with.
    """
    if isinstance(stream, OrderedJob):
        return stream.start(path, checkpoint, available_now)
    conf = stream.sparkSession.conf
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if state_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {k: conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        writer = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
                  .option("checkpointLocation", checkpoint))
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


# ---- events and windows ------------------------------------------------------------------------

def event_identity(events: DataFrame) -> list[str]:
    """The columns of ``events`` that identify one."""
    if set(RECORD_KEY) <= set(events.columns):
        return list(RECORD_KEY)
    return [c for c in EVENT_KEY if c in events.columns]


def stream_dedupe(events: DataFrame, delay: str, key: Sequence[str] | None = None) -> DataFrame:
    """Drop re-read events; keys are forgotten once the watermark has passed them."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(key or event_identity(events)))


def stream_process_windows(events: DataFrame, delay: str, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Final process windows of the live stream, each emitted once after the watermark has passed it.

    Same filter and features as the batch job. Re-read events go first, so late ones are dropped and counted there, once each.
    Equal facts of a window are then counted, spread by value, and the last step adds them up.
    """
    rows = (windowed_rows(event_filter(stream_dedupe(events, delay)))
            .withColumn("w", F.window("timestamp", f"{window_seconds} seconds")))
    key = ("computer", "process_key", "w")
    counted = window_facts(rows, key).groupBy(*key, "kind", "value").agg(F.count(F.lit(1)).alias("_n"))
    windows = counted.groupBy(*key).agg(*window_totals("_n"))
    return windows.select("computer", "process_key", F.col("w.start").alias("window_start"),
                          *(c for c in windows.columns if c not in key))


class LateRows:
    """Counts the rows that a query drops because they came behind the watermark, over the whole life of the query.

    A query keeps the reports of its latest 100 batches only, so a thread looks at them every ``seconds`` and adds up those
    it has not seen. Create it right after the start.
    """

    def __init__(self, query: StreamingQuery, seconds: float = 1.0) -> None:
        self._query, self._seen, self._total, self._lock = query, -1, 0, threading.Lock()
        threading.Thread(target=self._watch, args=(seconds,), daemon=True).start()

    def _watch(self, seconds: float) -> None:
        while self._query.isActive:
            self.total()
            time.sleep(seconds)

    def total(self) -> int:
        """Rows dropped so far."""
        with self._lock:
            for report in self._query.recentProgress:
                if report.batchId > self._seen:
                    self._seen = report.batchId
                    self._total += sum(op.numRowsDroppedByWatermark for op in report.stateOperators)
            return self._total


# ---- heartbeat ---------------------------------------------------------------------------------

class _Heartbeat(StatefulProcessor):
    """Last event and running total per host; a timer reports hosts that stay silent."""

    def __init__(self, threshold: float) -> None:
        self.threshold_ms = int(threshold * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("beat", "last_us bigint, total bigint")

    @staticmethod
    def _row(key, last_us: int, resumed_us: int | None, total: int) -> dict:
        return {"computer": key[0], "last_event_us": last_us, "resumed_us": resumed_us, "total_events": total}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        last, total = (held[0], held[1]) if held else (None, 0)
        out = []
        beats = pd.concat(rows).sort_values("first_us")
        for first, newest, n in zip(beats["first_us"], beats["last_us"], beats["n"]):
            if last is not None and first - last > self.threshold_ms * 1000:
                out.append(self._row(key, last, int(first), total))
            last, total = int(newest), total + int(n)
        self.state.update((last, total))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.threshold_ms + 1)
        yield pd.DataFrame(out, columns=["computer", "last_event_us", "resumed_us", "total_events"]).astype(
            {"resumed_us": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, total = self.state.get()
        yield pd.DataFrame([self._row(key, last, None, total)]).astype({"resumed_us": "Int64"})

    def close(self) -> None:
        pass


def stream_heartbeat(events: DataFrame, delay: str, threshold: float = SILENCE_SECONDS) -> DataFrame:
    """Silences per host: a row without ``resumed_at`` when a host falls silent, one with it when events return.

    Events are first counted per host and second, so a busy host sends at most one row per second on.
    """
    beats = (events.withWatermark("timestamp", delay).groupBy("computer", F.window("timestamp", "1 second").alias("w"))
             .agg(F.min(F.unix_micros("timestamp")).alias("first_us"), F.max(F.unix_micros("timestamp")).alias("last_us"),
                  F.count(F.lit(1)).alias("n"))
             .select("computer", "first_us", "last_us", "n", F.window_time("w").alias("at")))
    out = beats.groupBy("computer").transformWithStateInPandas(
        _Heartbeat(threshold), "computer string, last_event_us bigint, resumed_us bigint, total_events bigint", "append", "EventTime")
    gap = (F.col("resumed_us") - F.col("last_event_us")) / 1e6
    return out.select("computer", F.timestamp_micros("last_event_us").alias("last_event"),
                      F.timestamp_micros("resumed_us").alias("resumed_at"), gap.alias("gap_seconds"), "total_events",
                      F.when(F.col("resumed_us").isNull(), "SENSOR_SILENCED").otherwise("HEALTHY").alias("status"))


# ---- alerts ------------------------------------------------------------------------------------

def _joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """An equality join in which nulls equal each other; ``left``'s names stay."""
    other = right.withColumnsRenamed({n: f"_of_{n}" for n in names})
    out = left.join(other, reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names)), how)
    return out.drop(*(f"_of_{n}" for n in names))


def _score_batch(model: SequenceModel, threshold: float, horizon: int, batch: DataFrame, state: State) -> tuple[DataFrame, State]:
    """Scores of a micro-batch, each host's stored vectors first, and what the next batch needs of it."""
    names = [f"x{i}" for i in range(len(model.scaler.features))]
    hosts, past, raised = durable(batch.groupBy("computer").agg(F.max("window_us").alias("newest"))), state["history"], state["raised"]
    back = _joined(past, hosts, ["computer"], "left_semi").withColumns({"fresh": F.lit(False), "window_us": F.col("place")}).drop("place")
    rows = batch.withColumn("fresh", F.lit(True)).unionByName(back, allowMissingColumns=True)

    def pooled(w):
        held, total = F.count(F.lit(1)).over(w), F.lit(model.intercept)
        for n, mean, top in zip(names, model.mean_weights, model.max_weights):
            largest = F.max(n).over(w)  # steps before the first window are zeros
            total = total + F.lit(mean) * F.sum(n).over(w) / model.length + F.lit(top) * F.when(held < model.length, F.greatest(largest, F.lit(0.0))).otherwise(largest)
        return {"risk_score": F.when(F.col("gated"), 0.0).otherwise(sigmoid(total))}
    scored = durable(trailing(rows, ("computer",), ("fresh", "window_us", "process_key", *names), model.length, pooled, keep_rn="place"))

    fresh = scored.filter("fresh")
    found = fresh.filter(F.col("risk_score") >= threshold).groupBy("computer", "window_us").agg(F.min("place").alias("place"))
    found = durable(_joined(found, raised, ["computer", "window_us"], "left_anti"))
    marks = found.select("computer", "place", F.lit(True).alias("alert_created"))
    output = (_joined(fresh, marks, ["computer", "place"], "left")
              .select("computer", "process_key", F.timestamp_micros("window_us").alias("window_start"), "technique_id", "risk_score",
                      F.coalesce("alert_created", F.lit(False)).alias("alert_created")))

    ends = scored.groupBy("computer").agg(F.max("place").alias("end"))
    history = _joined(scored, ends, ["computer"]).filter(F.col("place") > F.col("end") - (model.length - 1)).select("computer", "place", *names)
    away = _joined(past, hosts, ["computer"], "left_anti")
    known = raised.unionByName(found.select("computer", "window_us"))
    clock = (known.withColumnRenamed("window_us", "newest").unionByName(hosts).groupBy("computer").agg(F.max("newest").alias("now")))
    kept = _joined(known, clock, ["computer"]).filter(F.col("window_us") >= F.col("now") - horizon * 1_000_000).select("computer", "window_us")
    return output, {"history": history.unionByName(away), "raised": kept}


def stream_alerts(windows: DataFrame, model: SequenceModel, threshold: float = ALERT_THRESHOLD, horizon: int = 7 * 86_400) -> OrderedJob:
    """Score each final window with its host's history; one incident per host and window time.

    Benign sources and idle windows score 0 but stay part of the history. Windows of a micro-batch are taken in time order, and a hot
    host's are spread over tasks. State holds ``model.length - 1`` vectors a host and the times of its incidents of the
    last ``horizon`` seconds before its newest window; an older window that comes again may raise its incident again.
    """
    gated = benign_technique(F.col("technique_id")) | low_activity(
        F.col("event_count"), F.col("file_activity_count"), F.col("registry_activity_count"))
    scaled = [c.cast("double").alias(f"x{i}") for i, c in enumerate(model.scaler.columns())]
    rows = windows.select("computer", "process_key", F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_us"),
                          "technique_id", gated.alias("gated"), *scaled)
    vector = ", ".join(f"x{i} double" for i in range(len(scaled)))
    return OrderedJob(rows, partial(_score_batch, model, threshold, horizon),
                      "computer string, process_key string, window_start timestamp, technique_id string, risk_score double, alert_created boolean",
                      {"history": f"computer string, place bigint, {vector}", "raised": "computer string, window_us bigint"})


def incidents_of(scored: DataFrame | OrderedJob) -> DataFrame | OrderedJob:
    """Incident rows of the alert stream."""
    if isinstance(scored, OrderedJob):
        return scored.then(incidents_of)
    return scored.filter("alert_created").select(
        F.col("window_start").alias("timestamp"), "computer", F.col("technique_id").alias("ransomware_family"),
        "risk_score", pid_from_key(F.col("process_key")).alias("process_id"), F.lit("ACTIVE").alias("status"))


def _hand_over_batch(threshold: float, kept: int, batch: DataFrame, state: State) -> tuple[DataFrame, State]:
    """The riskiest row of each alert that was not handed over before."""
    best = durable(batch.groupBy("computer", "alert_us").agg(F.max(F.struct("risk_score", "process_key")).alias("x")).select("computer", "alert_us", "x.*"))
    new = _joined(best, state["done"], ["computer", "alert_us"], "left_anti")
    act, pid = F.col("risk_score") >= threshold, pid_from_key(F.col("process_key"), default=None)
    output = new.select(F.timestamp_micros("alert_us").alias("alert_id"), "computer", "risk_score", F.when(act, pid).alias("process_id"),
                        (act & pid.isNotNull()).alias("terminate_tree"), act.alias("isolate_host"), F.lit("dry_run").alias("mode"))
    done = state["done"].unionByName(new.select("computer", "alert_us"))
    clock = done.groupBy("computer").agg(F.max("alert_us").alias("now"))
    left = _joined(done, clock, ["computer"]).filter(F.col("alert_us") >= F.col("now") - kept * 1_000_000).drop("now")
    return output, {"done": left}


def alert_handoff(alerts: DataFrame, ignored: DataFrame | None = None, threshold: float = ALERT_THRESHOLD, kept: int = 7 * 86_400) -> OrderedJob:
    """Each alert, known by host and time, handed over once as a row of intents; nothing is executed.

    Alerts present at the start (``ignored(computer, alert_id)``) are left out; of several alerts of one host and time that come together
    the riskiest counts, later ones do not. State is one row an alert, so no earlier output is read again; it is forgotten ``kept``
    seconds behind the host's newest alert, and an older alert that comes again after that is handed over again.
    """
    at = F.coalesce("window_start", "timestamp") if "timestamp" in alerts.columns else F.col("window_start")
    rows = alerts.withColumn("alert_id", at).filter("alert_id IS NOT NULL AND risk_score IS NOT NULL")
    if ignored is not None:
        rows = rows.join(ignored.select("computer", "alert_id"), ["computer", "alert_id"], "left_anti")
    rows = rows.select("computer", F.unix_micros(F.col("alert_id").cast("timestamp")).alias("alert_us"), F.coalesce("process_key", F.lit("")).alias("process_key"), "risk_score")
    return OrderedJob(rows, partial(_hand_over_batch, threshold, kept),
                      "alert_id timestamp, computer string, risk_score double, process_id int, terminate_tree boolean, isolate_host boolean, mode string",
                      {"done": "computer string, alert_us bigint"})


# ---- escalation --------------------------------------------------------------------------------

_SPOT = "struct<window_us: bigint, process_key: string, risk_score: double>"


def _escalate_batch(batch: DataFrame, state: State) -> tuple[DataFrame, State]:
    """Firsts of the batch's episodes, where the first episode goes on from the one that the host was in."""
    held = state["level"]
    firsts = durable(episode_firsts(batch, ("computer",), ("window_us", "process_key")))
    before = held.select("computer", F.col("episode").alias("base"), F.col("w").alias("old_w"), F.col("c").alias("old_c"))
    goes_on = F.col("episode") == 0
    level = durable(_joined(firsts, before, ["computer"], "left").select(
        "computer", (F.coalesce("base", F.lit(0)) + F.col("episode")).cast("long").alias("episode"), "w", "c",
        F.when(goes_on, F.col("old_w")).alias("old_w"), F.when(goes_on, F.col("old_c")).alias("old_c")))
    w, c, old_w, old_c = (F.col(n) for n in ("w", "c", "old_w", "old_c"))
    warned = F.coalesce(old_w, F.when(c.isNull() | (w < c), w))  # the warning that stands when the critical score comes

    def change(kind, opened, at, status):
        return F.struct(kind.alias("change"), opened["window_us"].alias("opened_us"), at["window_us"].alias("at_us"), at["risk_score"].alias("risk_score"),
                        F.lit(status).alias("status"))
    changes = F.array_compact(F.array(
        F.when(old_w.isNull() & w.isNotNull(), change(F.lit("OPENED"), w, w, "MONITORING")),
        F.when(old_c.isNull() & c.isNotNull(), change(F.when(warned.isNull(), "OPENED").otherwise("UPGRADED"), F.coalesce(warned, c), c, "ACTIVE"))))
    output = level.select("computer", "episode", F.explode(changes).alias("x")).select(
        "computer", "episode", "x.change", F.timestamp_micros("x.opened_us").alias("opened_at"), F.timestamp_micros("x.at_us").alias("changed_at"),
        "x.risk_score", "x.status")
    now = level.groupBy("computer").agg(F.max_by(F.struct("episode", F.coalesce(old_w, w).alias("w"), F.coalesce(old_c, c).alias("c")), "episode").alias("x"))
    now = now.select("computer", "x.*")
    return output, {"level": now.unionByName(_joined(held, now, ["computer"], "left_anti"))}


def stream_escalation(scored: DataFrame) -> OrderedJob:
    """Incident changes per host as scores arrive: opened with a status, or upgraded to ACTIVE.

    A micro-batch's scores are taken in time order. State is a row a host: the number of its episode and the episode's firsts.
    """
    rows = scored.filter(decisive(F.col("risk_score"))).select(
        "computer", "process_key", F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_us"), "risk_score")
    return OrderedJob(rows, _escalate_batch, "computer string, episode bigint, change string, opened_at timestamp, changed_at timestamp, risk_score double, status string",
                      {"level": f"computer string, episode bigint, w {_SPOT}, c {_SPOT}"})
