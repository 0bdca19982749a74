"""Listing queries: filters, pages, newest rows and dashboard figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import (basename_image, benign_technique, contains_ci, ilike_escaped, low_activity, pid_from_key,
                         risk_band)
from ..schemas import ALERT_FIELDS, ALERT_THRESHOLD, DEFAULT_PAGE, MAX_PAGE
from ..session import durable
from .ordering import trailing

# Rows shown by the stream list and the risk chart, score that counts as an anomaly.
STREAM_ROWS = 15
CHART_ROWS = 30
MEMORY_ROWS = 40
ANOMALY_RISK = 0.5
MISSING_RISK = 0.05


def alert_threshold(scored: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    return scored.filter(F.col("risk_score") >= threshold)


def alert_project(scored: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Alerting rows with those alert fields that exist."""
    return alert_threshold(scored, threshold).select(*(f for f in ALERT_FIELDS if f in scored.columns))


def gate_scores(scored: DataFrame) -> DataFrame:
    """Zero the risk of benign sources and idle windows."""
    quiet = benign_technique(F.col("technique_id")) | low_activity(
        F.col("event_count"), F.col("file_activity_count"), F.col("registry_activity_count"))
    return scored.withColumn("risk_score", F.when(quiet, 0.0).otherwise(F.col("risk_score")))


def search(df: DataFrame, fields: Mapping[str, str], escaped_like: bool = False) -> DataFrame:
    """Keep rows whose columns contain the given texts, ignoring case; empty texts do not filter."""
    for column, value in fields.items():
        if value and column in df.columns:
            test = ilike_escaped(F.col(column), value) if escaped_like else contains_ci(F.col(column), value)
            df = df.filter(test)
    return df


def min_risk(df: DataFrame, text: str | float | None) -> DataFrame:
    """Keep rows at or above a risk; text that is no number does not filter; missing scores are 0."""
    try:
        least = float(text or 0)
    except ValueError:
        return df
    return df.filter(F.coalesce(F.col("risk_score"), F.lit(0.0)) >= least)


def page_bounds(limit=DEFAULT_PAGE, offset=0) -> tuple[int, int]:
    """Limit clamped to 1..1000 and offset to at least 0; (100, 0) when either is no integer."""
    try:
        limit, offset = int(limit), int(offset)
    except (TypeError, ValueError):
        return DEFAULT_PAGE, 0
    return max(1, min(limit, MAX_PAGE)), max(0, offset)


def page(df: DataFrame, order: Sequence[Column], limit=DEFAULT_PAGE, offset=0) -> DataFrame:
    """One page in the given order, each row with the total number of matching rows."""
    limit, offset = page_bounds(limit, offset)
    df = durable(df)  # the matching rows are made once, for the page and the total
    total = df.agg(F.count(F.lit(1)))
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total.scalar())


def newest(df: DataFrame, rows: int, time: str = "window_start", ties: Sequence[str] = ("computer", "process_key")):
    """The newest rows; ``rows`` is the size of a list on screen."""
    return df.orderBy(F.desc(time), *ties).limit(rows)


def alert_to_incident(alerts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Incident rows from alert rows, after the columns in ``keep``."""
    def field(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in alerts.columns else F.lit(default)
    times = [F.col(c) for c in ("timestamp", "window_start") if c in alerts.columns]
    return alerts.select(
        *keep, F.coalesce(*times).alias("timestamp"), field("computer", "unknown-host").alias("computer"),
        field("technique_id", "Ransomware").alias("ransomware_family"),
        field("risk_score", 0.0).cast("double").alias("risk_score"),
        pid_from_key(F.col("process_key")).alias("process_id"), F.lit("ACTIVE").alias("status"))


def incident_label(incident_id: Column) -> Column:
    return F.concat(F.lit("INC-"), incident_id)


def activity_flags(windows: DataFrame) -> DataFrame:
    """Short process name and which kinds of activity a window shows."""
    def active(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) > 0
    return windows.select(
        "computer", "process_key", "window_start",
        basename_image(F.coalesce("process_key", F.lit("system_idle"))).alias("image_name"),
        active("file_activity_count").alias("has_file"), active("registry_activity_count").alias("has_registry"),
        active("network_activity_count").alias("has_network"), active("event_1_count").alias("has_process"))


def rolling_max(scored: DataFrame, group: Sequence[str] = ("computer",), rows: int = 3) -> DataFrame:
    """Largest risk of the current and the previous ``rows - 1`` windows in time order."""
    return trailing(scored, group, ("window_start", "process_key"), rows,
                    lambda w: {"smoothed_risk": F.max("risk_score").over(w)})


def dashboard_kpis(scored: DataFrame) -> DataFrame:
    """Totals over all windows; average risk and anomalies over the newest rows on screen."""
    rows = durable(scored.select("window_start", "computer", "process_key", "risk_score", "anomaly_score"))  # windows are built once
    chart = newest(rows, CHART_ROWS).withColumn("_risk", F.coalesce("risk_score", F.lit(MISSING_RISK)))
    recent = Window.orderBy("window_start", F.desc("computer"), F.desc("process_key"))  # CHART_ROWS rows
    shown = chart.select(F.max("_risk").over(recent.rowsBetween(-2, 0)).alias("s"), "anomaly_score", "risk_score",
                         F.row_number().over(Window.orderBy(F.desc("window_start"), "computer", "process_key")).alias("rn"))
    elevated = (F.coalesce("anomaly_score", F.lit(0.0)) > 0) | (F.coalesce("risk_score", F.lit(0.0)) >= ANOMALY_RISK)
    figures = shown.agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("risk"), F.count_if((F.col("rn") <= STREAM_ROWS) & elevated).alias("anomalies"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return figures.select(total.alias("total_windows"), F.round("risk", 6).alias("average_risk"), risk_band(F.col("risk")).alias("band"),
                          "anomalies", (total / 10).alias("rate"))
