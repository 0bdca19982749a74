"""Names, fixed values and declared schemas shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# Supported event ids and their grouping.
EVENT_IDS = (1, 3, 7, 11, 12, 13, 23, 26)
FILE_EVENT_IDS = (11, 23, 26)
REGISTRY_EVENT_IDS = (12, 13)
NETWORK_EVENT_IDS = (3,)
ZERO_GUID = "{00000000-0000-0000-0000-000000000000}"

# Model inputs, thresholds and sizes.
WINDOW_SECONDS = 5
SEQUENCE_LENGTH = 30
ALERT_THRESHOLD = 0.85
WARNING_THRESHOLD = 0.60
RESET_THRESHOLD = 0.20
SILENCE_SECONDS = 30
DEFAULT_PAGE = 100
MAX_PAGE = 1000
DEFAULT_PID = 9999
RAW_REPRESENTATION = "raw_sysmon"

WINDOW_KEY = ("computer", "process_key", "window_start")
WINDOW_FEATURES = (
    "event_count", "unique_images", "unique_files", "unique_extensions", "unique_destination_ips",
    "suspicious_path_count", "file_activity_count", "registry_activity_count", "network_activity_count",
    *(f"event_{i}_count" for i in EVENT_IDS),
)
IDENTIFIER_COLUMNS = frozenset({
    "computer", "process_key", "window_start", "label", "technique_id", "scenario",
    "source", "source_kind", "dataset_source", "representation",
})
ALERT_FIELDS = (
    "timestamp", "window_start", "computer", "process_key", "source", "technique_id", "scenario",
    "risk_score", "anomaly_score", "would_alert", "mode",
)

EVENT_TEXT_FIELDS = (
    "computer", "process_guid", "process_id", "image", "parent_image", "command_line",
    "target_filename", "target_object", "destination_ip", "destination_port",
)

_summary = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
REPORT_SCHEMA = T.StructType([
    T.StructField("info", T.StructType([T.StructField("score", T.DoubleType())])),
    T.StructField("target", T.StructType([T.StructField("file", T.StructType([T.StructField("name", T.StringType())]))])),
    T.StructField("behavior", T.StructType([
        T.StructField("apistats", T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))),
        T.StructField("summary", _summary),
        T.StructField("processes", T.ArrayType(T.StructType([
            T.StructField("time", T.DoubleType()),
            T.StructField("calls", T.ArrayType(T.StructType([T.StructField("api", T.StringType())]))),
        ]))),
    ])),
    T.StructField("strings", T.ArrayType(T.StringType())),
    T.StructField("dropped", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))),
    T.StructField("signatures", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
])

AV_REPORT_SCHEMA = T.StructType([
    T.StructField("attributes", T.StructType([
        T.StructField("creation_date", T.LongType()),
        T.StructField("first_submission_date", T.LongType()),
        T.StructField("last_analysis_stats", T.MapType(T.StringType(), T.LongType())),
        T.StructField("md5", T.StringType()),
        T.StructField("sandbox_verdicts", T.MapType(T.StringType(), T.StructType([
            T.StructField("malware_names", T.ArrayType(T.StringType())),
            T.StructField("malware_classification", T.ArrayType(T.StringType())),
        ]))),
        T.StructField("sha1", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("type_extension", T.StringType()),
    ])),
])
