"""Which features made a window risky."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources import snapshots
from .models import LinearModel

# Attributions shown for known families when none were computed.
FAMILY_FALLBACK = {
    "wannacry": (("file_activity_count (mass file writes)", 0.48),
                 ("unique_extensions (.WNCRY extension writes)", 0.35),
                 ("event_1_count (vssadmin shadow copy wipe)", 0.32),
                 ("suspicious_path_count (executes from Temp path)", 0.28),
                 ("network_activity_count (SMB port 445 connection)", 0.15),
                 ("system_executable (untrusted binary location)", -0.12)),
    "lockbit": (("file_activity_count (rapid file modification)", 0.52),
                ("unique_extensions (.lockbit extension append)", 0.44),
                ("registry_activity_count (disabling Defender service)", 0.31),
                ("event_1_count (powershell payload execution)", 0.24),
                ("network_activity_count (c2 IP data transfer)", 0.12),
                ("system_executable (unregistered binary location)", -0.09)),
    "ryuk": (("event_1_count (vssadmin shadow copy deletion)", 0.49),
             ("file_activity_count (mass file encryption rate)", 0.46),
             ("registry_activity_count (Run key persistence creation)", 0.28),
             ("suspicious_path_count (AppData/Local/Temp execution)", 0.22),
             ("unique_images (non-whitelisted executable process)", 0.18),
             ("system_executable (non-system directory execution)", -0.14)),
    "blackbasta": (("file_activity_count (mass file encryption rate)", 0.51),
                   ("unique_extensions (.basta extension appended)", 0.42),
                   ("event_1_count (cmd.exe shadow copy wipe)", 0.36),
                   ("registry_activity_count (modifying security settings)", 0.27),
                   ("network_activity_count (exfiltration socket connection)", 0.16),
                   ("system_executable (untrusted process binary)", -0.10)),
    "sodinokibi": (("file_activity_count (encryption rate)", 0.54),
                   ("unique_extensions (unique random extensions)", 0.39),
                   ("event_1_count (process spawning cmd.exe)", 0.29),
                   ("registry_activity_count (modifying user settings)", 0.25),
                   ("network_activity_count (command & control callback)", 0.14),
                   ("system_executable (unregistered binary)", -0.10)),
}
DEFAULT_FALLBACK = (("file_activity_count (high file system modifications)", 0.45),
                    ("event_1_count (suspicious process creation)", 0.35),
                    ("suspicious_path_count (executes from local temp)", 0.27),
                    ("registry_activity_count (persistence creation)", 0.19),
                    ("system_executable (binary path verification)", -0.11))


def _entries(values: Sequence[tuple[str, Column]]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(n).alias("feature_name"), v.cast("double").alias("importance_value"))
                               for n, v in values)))


def linear_attribution(alerts: DataFrame, model: LinearModel, key: str = "alert_id") -> DataFrame:
    """Coefficient times scaled value of every feature, one row per alert and feature."""
    missing = {f: F.lit(0.0) for f in model.scaler.features if f not in alerts.columns}
    parts = list(zip(model.scaler.features, model.contributions()))
    return alerts.withColumns(missing).select(key, _entries(parts).alias("e")).select(key, "e.*")


def attribution_order(attributions: DataFrame, key: str = "alert_id") -> DataFrame:
    """Rank within each alert by absolute importance; an alert has one row per feature."""
    order = Window.partitionBy(key).orderBy(F.abs("importance_value").desc(), "feature_name")
    return attributions.withColumn("position", F.row_number().over(order))


def explanation_cache(stored: DataFrame, computed: DataFrame, key: str = "alert_id") -> DataFrame:
    """Stored attributions; computed ones only for alerts that have none."""
    fresh = computed.join(stored.select(key).distinct(), key, "left_anti")
    return (stored.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False))))


def store_explanations(computed: DataFrame, root: str, key: str = "alert_id") -> DataFrame:
    """Store the attributions of alerts that have none yet, as a new snapshot of the table at ``root``; returns all that are stored.

    Alerts that are stored already keep what they have, so a second run adds nothing.
    """
    snapshots.upsert(computed, root, (key,), replace=False)
    return snapshots.read_snapshot(computed.sparkSession, root)


def fallback_table(spark: SparkSession) -> DataFrame:
    """Fixed attributions per family; the empty family holds the default."""
    rows = [(family, n, v) for family, entries in (*FAMILY_FALLBACK.items(), ("", DEFAULT_FALLBACK)) for n, v in entries]
    return spark.createDataFrame(rows, "family string, feature_name string, importance_value double")


def family_fallback(incidents: DataFrame, attributions: DataFrame, key: str = "alert_id") -> DataFrame:
    """Fixed attributions of the family for incidents that have none of their own."""
    family = F.lower(F.trim("ransomware_family"))
    bare = (incidents.join(attributions.select(key).distinct(), key, "left_anti")
            .withColumn("family", F.when(family.isin(*FAMILY_FALLBACK), family).otherwise(F.lit(""))))
    filled = bare.join(F.broadcast(fallback_table(incidents.sparkSession)), "family")  # 35 fixed rows
    return attributions.select(key, "feature_name", "importance_value").unionByName(
        filled.select(key, "feature_name", "importance_value"))


def incident_vector_lookup(wanted: DataFrame, incidents: DataFrame, windows: DataFrame) -> DataFrame:
    """Incidents found by id or by timestamp, with the first window of the same time and computer.

    The either-or condition is two equality joins; the smallest process key is the first window.
    """
    keyed = incidents.select("id", "timestamp", "computer").withColumns(
        {"_id": F.col("id").cast("string"), "_time": F.col("timestamp").cast("string")})
    found = reduce(DataFrame.unionByName, (
        wanted.join(keyed, F.col("alert_ref") == F.col(c)).drop("_id", "_time") for c in ("_id", "_time")))
    found = (found.groupBy("alert_ref").agg(F.min_by(F.struct("id", "timestamp", "computer"), "id").alias("i"))
             .select("alert_ref", "i.*"))
    values = [c for c in windows.columns if c not in ("computer", "window_start")]
    timed = windows.withColumnRenamed("window_start", "timestamp")
    firsts = (timed.join(found.select("computer", "timestamp"), ["computer", "timestamp"], "left_semi")
              .groupBy("computer", "timestamp").agg(F.min_by(F.struct(*values), "process_key").alias("w")))
    return found.join(firsts, ["computer", "timestamp"], "left").select("alert_ref", "id", "timestamp", "computer", "w.*")


def new_incidents(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Alerts without an incident of the same time and computer."""
    return alerts.join(incidents.select("timestamp", "computer"), ["timestamp", "computer"], "left_anti")
