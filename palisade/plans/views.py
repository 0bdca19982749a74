"""Domain views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.telemetry import event_filter, process_windows, windowed_rows
from ..schemas import WINDOW_KEY, ZERO_GUID

DAY = 86_400
SIGNING_KEY = "unit-test-signing-key"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(index: Column, *values) -> Column:
    """Element ``index`` (0-based) of a literal list."""
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry_of(table(spark, sf, "events"))


def telemetry_of(rows: DataFrame) -> DataFrame:
    """Endpoint events from event rows: `event_id` is still text and may be malformed or unsupported."""
    k, uid = F.col("k"), F.col("user_id")
    events = rows.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    target = (F.when(k % 4 == 0, F.lit(""))
              .when(k % 4 == 1, F.concat(F.lit("C:/Users/u/AppData/f"), k, F.lit(".DAT")))
              .when(k % 4 == 2, F.concat(F.lit("C:\\Temp\\f"), k, F.lit("."), F.col("event_type")))
              .otherwise(F.concat(F.lit("D:\\data\\f"), k)))
    guid = (F.when(uid % 10 == 0, F.lit("")).when(uid % 10 == 1, F.lit(ZERO_GUID))
            .otherwise(F.concat(F.lit("{"), uid, F.lit("}"))))
    return events.select(
        F.col("event_id").alias("row_id"), "k", "user_id", "event_type", "value",
        F.col("ts").alias("timestamp"),
        _pick(k % 10, "1", "3", "7", "11", "12", "13", "23", "26", "22", "bad").alias("event_id"),
        F.concat(F.lit("host-"), uid % 5).alias("computer"),
        guid.alias("process_guid"),
        F.when(uid % 50 == 0, F.lit("")).otherwise(uid.cast("string")).alias("process_id"),
        F.concat(F.lit("C:\\bin\\"), F.col("event_type"), F.lit(".exe")).alias("image"),
        target.alias("target_filename"),
        F.when(k % 10 == 5, F.concat(F.lit("HKLM\\k"), k)).alias("target_object"),
        F.when(k % 10 == 1, F.concat(F.lit("10.0.0."), k % 16)).otherwise(F.lit("")).alias("destination_ip"),
        _pick(k % 3, "vssadmin delete shadows", "CMD.EXE /C whoami", "notepad").alias("command_line"),
        F.concat(F.lit("log-"), uid % 11).alias("source"),
        F.when(uid % 11 < 5, 1).otherwise(0).alias("label"),
        F.concat(F.lit("scenario-"), uid % 4).alias("scenario"),
        _pick(uid % 6, "T1486", "T1490", "benign", "T1059.001", "Monitoring", "T1547").alias("technique_id"),
        (F.least(F.col("value"), F.lit(100.0)) / 100).alias("risk"),
    )


def windows(spark: SparkSession, sf: str, seconds: int = DAY) -> DataFrame:
    """Process windows of the filtered telemetry."""
    return process_windows(event_filter(telemetry(spark, sf)), seconds)


def scored(spark: SparkSession, sf: str, seconds: int = DAY) -> DataFrame:
    """Process windows with a risk score, an anomaly score and lineage columns.

    All rows of one process share their user, so lineage is constant within a window up to the
    processes without a GUID, where the smallest value is taken.
    """
    lineage = {"risk_score": ("max", "risk"), "anomaly_score": ("min", "risk"), "source": ("min", "source"),
               "label": ("max", "label"), "scenario": ("min", "scenario"), "technique_id": ("min", "technique_id"),
               "window_id": ("min", "row_id")}
    rows = process_windows(event_filter(telemetry(spark, sf)), seconds, extra=lineage)
    return rows.withColumns({"risk_score": F.round("risk_score", 6), "anomaly_score": F.round(F.col("anomaly_score") - 0.3, 6)})


def lineage(spark: SparkSession, sf: str, seconds: int = DAY) -> DataFrame:
    """The windows of ``scored`` with id, label and scenario only: no event is split into facts and no feature is counted."""
    span = F.window("timestamp", f"{seconds} seconds").getField("start")
    rows = windowed_rows(event_filter(telemetry(spark, sf))).withColumn("window_start", span)
    return rows.groupBy(*WINDOW_KEY).agg(F.min("row_id").alias("window_id"), F.max("label").alias("label"), F.min("scenario").alias("scenario"))


def presence(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (sample_id, name): lower-case words (runs of a-z) of each document."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    return (table(spark, sf, "documents")
            .select(F.col("doc_id").alias("sample_id"), F.explode(F.array_distinct(words)).alias("name")))


def presence_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("sample_id"), F.col("quality").alias("label"), "toxic")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as sandbox samples with a type, a family, a source and a partly missing date."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    date = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        key.alias("sample_id"),
        F.when(status == "F", 0).otherwise(1).alias("sample_type"),
        F.col("o_orderpriority").alias("source"),
        F.concat(F.lit("family-"), F.col("o_custkey") % 16).alias("ransomware_family"),
        F.when(status == "F", "goodware").when(status == "O", "crypto").otherwise("locker").alias("ransomware_type"),
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("type_label"),
        F.when(key % 7 != 0, date).alias("submitted"),
        date.alias("first_submission"),
        F.col("o_totalprice").alias("size"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as labelled numeric rows f0..f63."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("label") < 5, 1).otherwise(0).alias("label"), F.col("label").alias("type_label"),
        *(F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """One sandbox report per event row."""
    k, uid, kind = F.col("k"), F.col("user_id"), F.col("event_type")

    def text(*parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    none = F.array().cast("array<string>")
    apistats = F.create_map(text(uid), F.create_map(text("Nt", kind), k.cast("long"), text("Reg", k % 7), F.lit(1).cast("long")),
                            text(uid, "b"), F.create_map(text("Nt", kind), F.lit(2).cast("long")))
    summary = F.create_map(
        F.lit("regkey_opened"), F.array(text("HKLM\\A", k % 11), text("HKLM\\A", k % 11)),
        F.lit("regkey_written"), F.when(k % 2 == 0, F.array(text("HKCU\\Run", k % 5))).otherwise(none),
        F.lit("file_created"), F.array(text("C:\\Temp\\F", k % 13, ".TXT")),
        F.lit("file_deleted"), F.when(k % 3 == 0, F.array(text("C:\\Docs\\", kind))).otherwise(none),
        F.lit("directory_enumerated"), F.array(text("C:\\Users\\U", uid % 6)),
        F.lit("connects_ip"), F.when(k % 10 == 1, F.array(text("10.0.0.", k % 16))).otherwise(none),
        F.lit("resolves_host"), F.array(text("C2-", k % 4, ".Example")),
        F.lit("dll_loaded"), F.array(text("KERNEL", k % 3, ".dll"), F.lit("ntdll.DLL")),
        F.lit("mutex"), F.array(text("M", uid % 9)),
        F.lit("regkey_deleted"), F.when(k % 4 == 0, F.array(text("HKU\\D", k % 3))).otherwise(none),
        F.lit("regkey_read"), F.array(text("HKCR\\R", kind)),
        F.lit("file_recreated"), F.array(text("C:\\R", k % 6)),
        F.lit("file_opened"), F.array(text("D:\\O", k % 8), text("D:\\O", k % 3)),
        F.lit("file_written"), F.when(k % 5 == 0, F.array(text("C:\\W", k % 9))).otherwise(none),
        F.lit("file_exists"), F.array(text("C:\\E", k % 4)),
        F.lit("file_failed"), F.when(k % 6 == 0, F.array(text("C:\\X", k % 3))).otherwise(none),
        F.lit("file_read"), F.array(text("C:\\L", uid % 7)),
        F.lit("directory_created"), F.array(text("C:\\N", k % 5)),
        F.lit("connects_host"), F.when(k % 3 == 1, F.array(text("H", k % 6, ".EX"))).otherwise(none),
        F.lit("command_line"), F.array(text("Run ", kind)),
        F.lit("guid"), F.array(text("{A", k % 10, "}")),
        F.lit("unrelated"), F.array(F.lit("ignored")))
    dropped = F.array(
        F.struct(text("a.b.EXT", k % 6).alias("name"), F.lit("PE32 executable (GUI)").alias("type")),
        F.struct(text("noext", k % 3).alias("name"), F.when(k % 2 == 0, "ASCII text").otherwise("").alias("type")))
    calls = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")),
                        lambda i: F.struct(F.concat(F.lit("Api"), (k + i) % 5).alias("api")))
    process = F.struct((uid / 2).alias("time"), calls.alias("calls"))
    names = _pick(k % 5, "WannaCry", "Ryuk", "setup", "LockBit", "notes")
    return telemetry(spark, sf).select(
        F.col("row_id").alias("sample_id"), F.struct((k / 10).alias("score")).alias("info"),
        F.struct(F.struct(names.alias("name")).alias("file")).alias("target"),
        F.struct(apistats.alias("apistats"), summary.alias("summary"),
                 F.array(process, process).alias("processes")).alias("behavior"),
        F.array(text("Str", k), kind, F.upper(kind)).alias("strings"), dropped.alias("dropped"),
        F.array(F.struct(text("Sig_", kind).alias("name"))).alias("signatures"))
