"""Parsing, filtering, windows and vectors on small literals."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palisade import functions as X
from palisade.operators import counts, telemetry as T, vectors as M
from palisade.schemas import EVENT_IDS, WINDOW_FEATURES, ZERO_GUID
from palisade.sources import xml_events

NS = "xmlns='http://schemas.microsoft.com/win/2004/08/events/event'"


def event_xml(second, name="C:\\Temp\\a.locked", guid="{1}", event_id=11):
    return (f"<Event {NS}><System><EventID>{event_id}</EventID><TimeCreated SystemTime='2026-01-01T00:00:0{second}Z'/>"
            f"<Computer>pc</Computer></System><EventData><Data Name='ProcessGuid'>{guid}</Data>"
            f"<Data Name='Image'>C:\\x.exe</Data><Data Name='TargetFilename'>{name}</Data></EventData></Event>")


def read(spark, tmp_path, text):
    (tmp_path / "a.log").write_text(text, encoding="utf-8")
    return xml_events.xml_event_scan(spark, str(tmp_path), "*.log")


def test_log_to_window(spark, tmp_path):
    documents = read(spark, tmp_path, event_xml(1) + "\n" + event_xml(3, "C:\\Temp\\b.locked"))
    windows = T.process_windows(T.event_filter(xml_events.xml_event_parse(documents)), 5)
    row = windows.collect()
    assert len(row) == 1
    assert (row[0]["event_11_count"], row[0]["suspicious_path_count"], row[0]["unique_files"]) == (2, 2, 2)
    assert row[0]["unique_extensions"] == 1
    vector = M.vectorize(windows)
    assert vector.columns == list(WINDOW_FEATURES) and dict(vector.dtypes)["event_count"] == "double"


def test_event_fields_fall_back(spark, tmp_path):
    xml = (f"<Event {NS}><System><EventID Qualifiers='0'>3</EventID><TimeCreated SystemTime='s'/><Computer>pc</Computer></System><EventData>"
           "<Data Name='UtcTime'>u</Data><Data Name='ProcessGuid'></Data><Data Name='SourceProcessGUID'>{9}</Data>"
           "<Data Name='SourceImage'>i</Data><Data>unnamed</Data><Data Name='X'>1</Data><Data Name='X'>2</Data></EventData></Event>")
    row = xml_events.xml_event_parse(read(spark, tmp_path, xml)).first()
    assert (row["timestamp"], row["event_id"], row["process_guid"], row["image"], row["command_line"]) == ("u", 3, "{9}", "i", None)
    assert row["extra"]["X"] == "2"


def test_incomplete_event_fails(spark, tmp_path):
    documents = read(spark, tmp_path, event_xml(1) + event_xml(2)[:120])
    with pytest.raises(Exception, match="Incomplete or malformed"):
        xml_events.xml_event_parse(documents).collect()
    kept = xml_events.xml_event_parse(documents, strict=False)
    assert kept.filter("corrupt IS NULL").count() == 1


def events(spark, rows):
    names = "timestamp event_id computer process_guid process_id image target_filename".split()
    return spark.createDataFrame(rows, " string, ".join(names) + " string")


def test_filter_and_process_key(spark):
    rows = [("2026-01-01 00:00:01", "11", "pc", ZERO_GUID, "4", "a", "x.TXT"), ("2026-01-01 00:00:02", "11", "pc", None, "4", "a", None),
            ("2026-01-01 00:00:02", "x", "pc", "{1}", "4", "a", None), (None, "11", "pc", "{1}", "4", "a", None),
            ("2026-01-01 00:00:02", "22", "pc", "{1}", "4", "a", None), ("2026-01-01 00:00:02", "12", "pc", "", "", "a", None),
            ("noon", "12", "pc", "{1}", "4", "a", None)]
    windows = T.process_windows(T.event_filter(events(spark, rows))).collect()
    assert [(w["process_key"], w["event_count"], w["unique_files"]) for w in windows] == [("4:a", 2, 1)]


def test_sliding_windows_overlap(spark):
    rows = events(spark, [("2026-01-01 00:00:07", "11", "pc", "{1}", "4", "a", None)])
    starts = T.process_windows(T.event_filter(rows), 10, slide_seconds=5).orderBy("window_start").collect()
    assert [r["window_start"].second for r in starts] == [0, 5]


def test_window_length_must_be_positive(spark):
    with pytest.raises(ValueError):
        T.process_windows(events(spark, []), 0)


def test_event_counts_add_up_under_a_hot_window(spark):
    rows = (spark.range(3000).withColumn("event_id", F.element_at(F.array(*(F.lit(i) for i in EVENT_IDS)), (F.col("id") % 8 + 1).cast("int")))
            .withColumns({"timestamp": F.when(F.col("id") % 3 == 0, F.lit("2026-01-01 00:00:00"))
                          .otherwise(F.concat(F.lit("2026-01-01 00:0"), F.col("id") % 7, F.lit(":00"))).cast("timestamp"),
                          "computer": F.lit("pc"), "process_guid": F.lit("{1}"), "process_id": F.lit("1"), "image": F.lit("i"),
                          "target_filename": F.concat(F.lit("f"), F.col("id") % 900)}))
    windows = T.process_windows(T.event_filter(rows))
    total = windows.agg(F.sum("event_count"), F.sum(sum(F.col(f"event_{i}_count") for i in EVENT_IDS))).first()
    assert tuple(total) == (3000, 3000)
    hot = windows.orderBy(F.desc("event_count")).first()
    at_midnight = {i % 900 for i in range(3000) if i % 3 == 0 or i % 7 == 0}
    assert hot["unique_files"] == len(at_midnight)


def test_count_windows(spark):
    rows = (spark.range(200).withColumns({
        "class": (F.col("id") >= 100).cast("int"), "code": F.lit("11"), "image": F.lit("i"),
        "target": F.concat(F.lit("C:\\d\\f"), F.col("id") % 4, F.lit(".locked")), "command_line": F.lit("POWERSHELL -enc")}))
    windows = counts.count_windows(rows, ("id",)).orderBy("window_start").collect()
    assert len(windows) == 20
    assert windows[0]["window_start"] == datetime(2026, 8, 6) and windows[1]["window_start"] == datetime(2026, 8, 6, 0, 0, 10)
    assert [w["label"] for w in windows] == [0] * 10 + [1] * 10
    assert (windows[0]["unique_files"], windows[0]["unique_extensions"], windows[0]["unique_destination_ips"]) == (4, 1, 0)
    assert windows[0]["suspicious_path_count"] == 10 and windows[6]["source"].endswith("_2")
    assert windows[0]["process_key"] == "PROC-00000"


def test_path_lineage(spark):
    paths = [("/d/attack_techniques/T1/atomic/x.log", "T1", "atomic"), ("/d/benign/host/x.log", "unknown", "host"),
             ("/d/attack_techniques/T1", "unknown", "attack_techniques")]
    technique, scenario = X.path_lineage(F.col("p"))
    rows = spark.createDataFrame(paths, "p string, t string, s string").select("t", "s", technique, scenario).collect()
    assert all((r[0], r[1]) == (r[2], r[3]) for r in rows)


def test_missing_features_and_json(spark):
    frame = spark.createDataFrame([("a", 1, None)], "computer string, x int, y double")
    assert M.feature_columns(frame) == ["x", "y"]
    assert M.align_to_model(frame, ("y", "z", "x")).first() == (0.0, 0.0, 1.0)
    packed = M.pack_features(frame, ("x", "y"))
    assert packed.first()["features_json"] == '{"x":1.0}'
    assert M.unpack_features(packed, ("x", "y")).select("x", "y").first() == (1.0, None)
