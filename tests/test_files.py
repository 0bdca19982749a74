"""File formats on small files."""

import hashlib
import json

from pyspark.sql import functions as F

from palisade.operators import presence
from palisade.sources import files, pages, reports


def test_hashes_skip_hidden_files(spark, tmp_path):
    for name in ("a.bin", ".hidden", "~$lock", "desktop.ini"):
        (tmp_path / name).write_bytes(b"abc")
    rows = files.binary_hashes(spark, str(tmp_path)).collect()
    assert [(r["filename"], r["md5"]) for r in rows] == [("a.bin", hashlib.md5(b"abc").hexdigest())]


def test_json_arrays_and_objects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}], indent=1))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"x": 3}, indent=1))
    rows = files.json_to_jsonl(spark, str(tmp_path / "in"), str(tmp_path / "out"), "x int").collect()
    assert sorted(r["x"] for r in rows) == [1, 2, 3]


def test_reports_take_their_id_from_the_file(spark, tmp_path):
    report = {"behavior": {"apistats": {"7": {"NtOpen": 3}}, "summary": {"regkey_read": ["HKLM\\X"], "file_read": ["C:\\A", "c:\\a"]}},
              "strings": ["Ab", "aB"], "dropped": [{"name": "x.EXE", "type": "PE file"}, {"name": "noext"}], "signatures": [{"name": "Sig"}]}
    (tmp_path / "10001.json").write_text(json.dumps(report, indent=1))
    (tmp_path / "10002.json").write_text("{broken")
    rows = reports.report_json_scan(spark, str(tmp_path))
    assert [r["sample_id"] for r in reports.malformed(rows).collect()] == [10002]
    named = presence.all_features(reports.readable(rows)).collect()
    assert {r["name"] for r in named} == {"API:NtOpen", "REG:READ:HKLM\\X", "FILE:READ:c:\\a", "STRING:ab", "DROP:EXTENSION:exe",
                                          "DROP:TYPE:pe_file", "SIGNATURE:sig"}
    assert len(named) == 7 and {r["sample_id"] for r in named} == {10001}


def test_listing_page(spark):
    html = """<a class="link_ttl" href="/one"> One <b>App</b></a><div class="description"> first
 text</div><a href="/skip">no</a><a href="/two" class="link_ttl">Two</a><p>para</p><a class="link_ttl" href="/three">Three</a>"""
    rows = pages.app_links(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("position").collect()
    assert [(r["href"], r["title"]) for r in rows] == [("/one", "One App"), ("/two", "Two"), ("/three", "Three")]
    assert [r["description"].split()[0] for r in rows] == ["first", "para", "No"]


def test_details_need_a_report(spark):
    html = """<a href="http://r">see the report</a><a class="download_btn" href="/get">Download</a>"""
    told = """<p class="file_info"><span>File: a.exe</span><span>Size: 1 MB</span><span>MD5: ff</span><span>Checked: today</span></p>"""
    rows = [(1, "http://1", html), (2, "http://2", html.replace("see the report", "nothing")), (3, "http://3", html.replace("download_btn", "x")),
            (4, "http://4", html.replace("http://r", "http://gone")), (5, "http://r", told)]
    rows = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert [tuple(r) for r in pages.application_details(rows).collect()] == [(1, "a.exe", "1 MB", "ff", "today", "/get")]


def test_log_screen(spark):
    lines = spark.createDataFrame([(1, "2024 ERROR: boom"), (2, "WARNING: Error x"), (3, "terrors"), (4, "an error happened")], "run_id int, value string")
    assert sorted(r["run_id"] for r in files.log_error_screen(lines.select("run_id"), lines).collect()) == [2, 3]


def test_counts_with_semicolons(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a;b\n1;2\n3;4\n")
    assert files.csv_scan(spark, str(tmp_path), "a int, b int", sep=";").agg(F.sum("b")).first()[0] == 6


def test_av_report(spark):
    good = {"attributes": {"md5": "m", "last_analysis_stats": {"malicious": 5, "harmless": 2}, "sandbox_verdicts": {"C2AE": {"malware_names": ["N", "O"]}}}}
    rows = spark.createDataFrame([(json.dumps(good),), ("{}",)], "report string")
    got = [(r["md5"], r["malicious"], r["total_avi_tested"], r["malware_names"], r["malware_classification"]) for r in reports.av_report_project(rows).collect()]
    assert got == [("m", 5, 7, "N", None), (None, None, 0, None, None)]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conditions_on_events_do_not_parse_again(spark):
    from palisade.operators.telemetry import event_filter
    from palisade.sources.xml_events import xml_event_parse
    xml = "<Event><System><EventID>1</EventID><Computer>c</Computer></System><EventData><Data Name='UtcTime'>t</Data><Data Name='ProcessId'>{}</Data></EventData></Event>"
    rows = spark.createDataFrame([("f", xml.format(7)), ("f", xml.format(""))], "file_path string, xml string")
    kept = event_filter(xml_event_parse(rows))
    assert plan(kept).count("from_xml(") == 1
    assert [(r["process_id"], r["extra"]["ProcessId"]) for r in kept.collect()] == [("7", "7")]


def test_conditions_on_reports_do_not_parse_again(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"sample_id": "5", "strings": ["x"]}\n{"sample_id": \n')
    rows = reports.report_json_scan(spark, str(tmp_path), one_per_file=False)
    assert plan(reports.readable(rows)).count("from_json(") == 1
    assert [r["sample_id"] for r in reports.readable(rows).collect()] == [5] and reports.malformed(rows).count() == 1
