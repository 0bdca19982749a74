"""Splits, models, scores, alerts and explanations."""

import hashlib
import hmac
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.functions import hmac_sha256
from palisade.operators import attribution as A
from palisade.operators import models as M
from palisade.operators import presence, process_tree, profiling, selection, serving
from palisade.operators import quality as Q
from palisade.operators import sequence_model as SM
from palisade.operators import splits as S
from palisade.plans import detection
from palisade.sources import alerts as AL

FEATURES = ("event_count", "file_activity_count")


@pytest.fixture(scope="module")
def windows(spark):
    rows = [(f"{kind}-{s}", label, f"2026-01-01 00:{s:02d}:{i:02d}", f"k{label}-{s}-{i}", "pc", "raw_sysmon",
             label * 10 + i % 4, label * 10 + (i * s) % 3, f"scenario-{s % 2}" if label else None)
            for label, kind in ((0, "benign"), (1, "attack")) for s in range(5) for i in range(12)]
    frame = spark.createDataFrame(rows, "source string, label int, t string, process_key string, computer string, "
                                  "representation string, event_count long, file_activity_count long, scenario string")
    return frame.withColumn("window_start", F.col("t").cast("timestamp")).withColumn("window_id", F.xxhash64("process_key")).drop("t")


def test_sources_do_not_leak(windows):
    assignment = S.source_split(windows)
    assert S.leakage(S.assign_split(windows, assignment)).count() == 0
    parts = {(r["label"], r["split"]): r["count"] for r in assignment.groupBy("label", "split").count().collect()}
    assert parts == {(l, p): n for l in (0, 1) for p, n in (("train", 3), ("validation", 1), ("test", 1))}


def test_three_sources_are_needed(windows):
    with pytest.raises(Exception, match="At least three distinct source logs"):
        S.source_split(windows.filter("source NOT IN ('benign-0', 'benign-1', 'benign-2')")).collect()


def test_train_report(windows):
    marks = windows.filter("label = 1").select("source").distinct().withColumn("encryption_start", F.lit("2026-01-01 01:00:00").cast("timestamp"))
    result = detection.train_baseline(windows, FEATURES, annotations=marks)
    rows = {r["split"]: r for r in result.report.collect()}
    assert result.linear.scaler.features == FEATURES and rows["train"]["sources"] == 6
    assert rows["test"]["roc_auc"] == 1.0 and rows["test"]["f1"] == 1.0 and rows["train"]["roc_auc"] is None
    assert rows["test"]["min_lead_seconds"] > 0
    scored = M.risk_score(windows, result.linear, anomaly=result.forest)
    assert {r["mode"] for r in scored.select("mode").distinct().collect()} == {"dry_run"}
    assert scored.filter("would_alert <> (risk_score >= 0.85)").count() == 0


def test_scenarios_without_benign_training_rows_have_no_figures(windows):
    report = detection.scenario_holdout(windows, FEATURES)  # all 60 benign rows are needed for testing
    assert sorted(r["held_out"] for r in report.collect()) == ["scenario-0", "scenario-1"] and "f1" not in report.columns


def test_scenarios_are_held_out(spark, windows):
    more = spark.range(600).select(F.lit("benign-9").alias("source"), F.lit(0).alias("label"), F.col("id").alias("window_id"),
                                   (F.col("id") % 4).alias("event_count"), (F.col("id") % 3).alias("file_activity_count"))
    report = detection.scenario_holdout(windows.unionByName(more, allowMissingColumns=True), FEATURES).collect()
    assert {r["held_out"]: (r["test_attack_windows"], r["test_benign_windows"], r["roc_auc"]) for r in report} == {
        "scenario-0": (36, 500, 1.0), "scenario-1": (24, 500, 1.0)}


def test_holdout_takes_only_part_of_the_benign_rows(spark):
    rows = spark.range(1500).select(F.col("id").alias("window_id"), F.when(F.col("id") < 300, 1).otherwise(0).alias("label"),
                                    F.concat(F.lit("s"), F.col("id") % 3).alias("scenario"))
    parts = S.holdout_assignment(rows, "s0", "window_id").groupBy("label", "part").count().collect()
    assert {(r["label"], r["part"]): r["count"] for r in parts} == {(1, "test"): 100, (1, "train"): 200, (0, "test"): 500, (0, "train"): 700}


def test_guards(windows):
    proxy = windows.withColumn("representation", F.lit("fasttext_embedding_proxy"))
    with pytest.raises(ValueError, match="proxy"):
        S.guard_representation(proxy)
    S.guard_representation(proxy, allow_proxy=True)
    with pytest.raises(ValueError, match="mix"):
        S.guard_representation(proxy.unionByName(windows), allow_proxy=True)
    with pytest.raises(ValueError, match="benign"):
        S.guard_labels(windows.filter("label = 1"))


def test_lead_time(spark):
    scored = spark.createDataFrame([("a", 1, "2026-01-01 00:00:00", 0.9), ("a", 1, "2026-01-01 00:00:30", 0.99), ("b", 1, "2026-01-01 00:00:00", 0.1)],
                                   "source string, label int, t string, risk_score double").withColumn("window_start", F.col("t").cast("timestamp"))
    marks = spark.createDataFrame([("a", "2026-01-01 00:01:00"), ("b", "2026-01-01 00:01:00")], "source string, e string").select(
        "source", F.col("e").cast("timestamp").alias("encryption_start"))
    assert {r["source"]: r["lead_seconds"] for r in Q.lead_time(scored, marks).collect()} == {"a": 60.0, "b": None}


def test_metrics_without_predictions(spark):
    row = Q.binary_metrics(spark.createDataFrame([(0.1, 1), (0.2, 1)], "risk_score double, label int")).first()
    assert (row["precision"], row["recall"], row["f1"], row["false_positive_rate"], row["fn"]) == (0.0, 0.0, 0.0, None, 2)


def test_ovr_auc_needs_every_class(spark):
    rows = spark.createDataFrame([(0, 0.9, 0.1, 0.0), (1, 0.2, 0.8, 0.0)], "y int, a double, b double, c double")
    assert Q.ovr_auc(rows, "y", {0: "a", 1: "b"}).first()[0] == 1.0
    assert Q.ovr_auc(rows, "y", {0: "a", 1: "b", 2: "c"}).first()[0] is None


def test_constant_feature_scales_to_zero(spark):
    scaler = M.fit_scaler(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ("a", "b"))
    assert scaler.deviation == (1.0, 1.0) and scaler.mean == (2.0, 5.0)


def test_isolation_forest_ranks_outliers(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(2000, 2)))], "id long, a double, b double")
    forest = M.train_isolation_forest(rows, ("a", "b"), "id")
    assert len(forest.trees) == 100 and forest.rows == 256 and all(len(t["cut"]) <= 511 for t in forest.trees)
    beyond = M.anomaly_score(rows, forest).filter("anomaly_score > 0").count()
    assert 0.03 < beyond / 2000 < 0.07
    probe = spark.createDataFrame([(0.0, 0.0), (2.5, 2.5), (9.0, 9.0)], "a double, b double")
    middle, edge, far = (r["anomaly_score"] for r in M.anomaly_score(probe, forest).collect())
    assert middle < edge < far and far > 0
    again = M.train_isolation_forest(rows.repartition(7), ("a", "b"), "id")
    assert all(np.allclose(x["cut"], y["cut"]) for x, y in zip(forest.trees, again.trees))


def test_rfe_keeps_the_telling_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    y = (x[:, 2] + x[:, 5] > 0).astype(int)
    rows = spark.createDataFrame([(int(l), *map(float, v)) for l, v in zip(y, x)], "label int, " + ", ".join(f"f{i} double" for i in range(8)))
    names = [f"f{i}" for i in range(8)]
    assert M.rfe(rows, names, keep=2) == ["f2", "f5"]
    path = M.rfe_path(rows, names, [2, 5, 8], step=0.3)
    assert path[2] == ["f2", "f5"] and set(path[2]) < set(path[5]) < set(path[8]) == set(names)
    assert path[5] == M.rfe(rows, names, keep=5, step=0.3)
    sweep = M.rfe_sweep(rows, rows, names, (25, 100)).collect()
    assert [(r["features"], r["balanced_accuracy"] > 0.95) for r in sweep] == [(2, True), (8, True)]


def test_sequence_model_uses_history(spark):
    rows = [(f"s{s}", f"s{s}", i, f"p{i}", float((s * 7 + i * 3) % 5) + (8.0 if s % 2 and i > 10 else 0.0), int(s % 2 and i > 10)) for s in range(8) for i in range(40)]
    frame = spark.createDataFrame(rows, "source string, computer string, window_start int, process_key string, x double, label int")
    model = SM.train_sequence(frame, ("x",))
    scored = SM.sequence_score(frame, model, absolute=True)
    assert Q.roc_auc(scored).first()["roc_auc"] > 0.97
    shares = SM.sequence_attribution(scored.withColumn("alert_id", F.monotonically_increasing_id()), model, "alert_id")
    totals = shares.groupBy("alert_id").agg(F.sum("importance_value").alias("t")).select("t").distinct().collect()
    assert all(t[0] == pytest.approx(10.0) for t in totals)


def test_sequence_attribution_matches_gradients(spark):
    model = SM.SequenceModel(M.Scaler(("x", "z"), (0.0, 0.0), (1.0, 1.0)), (0.5, -1.0), (0.3, 0.7), 0.0, length=4)
    values = [(1.0, -2.0), (3.0, 1.0), (-4.0, 0.5)]
    frame = spark.createDataFrame([("h", i, "p", *v) for i, v in enumerate(values)], "computer string, window_start int, process_key string, x double, z double")
    last = SM.sequence_score(frame, model, absolute=True).filter("window_start = 2").withColumn("alert_id", F.lit(1))
    got = {r["feature_name"]: r["importance_value"] for r in SM.sequence_attribution(last, model, "alert_id").collect()}
    padded = np.array([(0.0, 0.0), *values])
    raw = []
    for f, (m, x) in enumerate(zip(model.mean_weights, model.max_weights)):
        gradient = np.full(4, m / 4)
        gradient[padded[:, f].argmax()] += x
        raw.append(np.abs(gradient * padded[:, f]).mean())
    assert [got["x"], got["z"]] == pytest.approx([10 * v / sum(raw) for v in raw])


def test_linear_attribution_and_fallback(spark):
    model = M.LinearModel(M.Scaler(("a", "b"), (1.0, 0.0), (2.0, 1.0)), (4.0, -1.0), 0.0)
    alerts = spark.createDataFrame([(1, 3.0, 5.0)], "alert_id int, a double, b double")
    ranked = A.attribution_order(A.linear_attribution(alerts, model)).orderBy("position").collect()
    assert [(r["feature_name"], r["importance_value"]) for r in ranked] == [("b", -5.0), ("a", 4.0)]
    stored = spark.createDataFrame([(1, "a", 9.0)], "alert_id int, feature_name string, importance_value double")
    cached = A.explanation_cache(stored, A.linear_attribution(alerts, model)).collect()
    assert [(r["importance_value"], r["cached"]) for r in cached] == [(9.0, True)]
    incidents = spark.createDataFrame([(1, "ryuk"), (2, " LockBit "), (3, "other")], "alert_id int, ransomware_family string")
    filled = A.family_fallback(incidents, stored).groupBy("alert_id").count().collect()
    assert {r["alert_id"]: r["count"] for r in filled} == {1: 1, 2: 6, 3: 5}


def test_hmac_equals_the_standard_library(spark):
    for key in ("k", "x" * 64, "long" * 40):
        got = spark.createDataFrame([("grüße",)], "m string").select(hmac_sha256(F.col("m"), key)).first()[0]
        assert got == hmac.new(key.encode(), "grüße".encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        hmac_sha256(F.col("m"), "")


def test_signed_alerts(spark, tmp_path):
    rows = spark.createDataFrame([("pc", 0.9), ("pc2", 0.95)], "computer string, risk_score double")
    path = AL.write_alerts(rows, str(tmp_path / "alerts"), "key")
    assert sorted(AL.read_alerts(spark, path, "key", rows.schema.simpleString()[7:-1].replace(":", " ")).collect()) == sorted(rows.collect())
    assert AL.read_alerts(spark, str(tmp_path / "none"), "key", "computer string").count() == 0
    legacy = spark.createDataFrame([('[{"computer":"old","risk_score":0.7}]',)], "value string")
    legacy.write.text(str(tmp_path / "legacy"))
    assert AL.read_alerts(spark, str(tmp_path / "legacy"), "key", "computer string, risk_score double").first() == ("old", 0.7)
    with pytest.raises(RuntimeError, match="manifest"):
        AL.read_alerts(spark, str(tmp_path / "legacy"), "key", "computer string, risk_score double", legacy=False)
    plain = "computer string, risk_score double"
    lines = [line for f in (tmp_path / "alerts").glob("*.json") for line in f.read_text().splitlines()]
    tampered = {"removed": lines[:1], "repeated": lines[:1] * 2, "added": [*lines, '{"computer":"INJECTED","risk_score":1.0}'], "emptied": []}
    for name, kept in tampered.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.json").write_text("\n".join(kept))
        spark.read.schema(AL.MANIFEST).json(path + ".manifest").write.json(f"{folder}.manifest")
        with pytest.raises(RuntimeError, match="removed"):
            AL.read_alerts(spark, str(folder), "key", plain)
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "a.json").write_text("\n".join(lines))
    with pytest.raises(RuntimeError, match="manifest is missing"):
        AL.read_alerts(spark, str(tmp_path / "bare"), "key", plain)
    other = AL.write_alerts(rows, str(tmp_path / "moved"), "key")  # the same alerts of another table
    spark.read.schema(AL.MANIFEST).json(path + ".manifest").write.mode("overwrite").json(f"{other}.manifest")
    with pytest.raises(Exception, match="signature verification failed"):
        AL.read_alerts(spark, other, "key", plain).collect()
    empty = AL.write_alerts(rows.limit(0), str(tmp_path / "empty"), "key")
    assert AL.read_alerts(spark, empty, "key", plain).count() == 0
    spoiled = [json.loads(line) for f in (tmp_path / "alerts").glob("*.json") for line in f.read_text().splitlines()]
    spoiled[0]["payload"] = spoiled[0]["payload"].replace("0.9", "0.1")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text("\n".join(map(json.dumps, spoiled)))
    spark.read.schema(AL.MANIFEST).json(path + ".manifest").write.json(str(tmp_path / "bad.manifest"))
    with pytest.raises(Exception, match="signature verification failed"):
        AL.read_alerts(spark, str(tmp_path / "bad"), "key", "computer string, risk_score double").collect()


def test_pages_and_filters(spark):
    rows = spark.createDataFrame([("HOST-1", "T1", 0.9, 1), ("host_2", "T1", None, 2), ("pc", "T2", 0.3, 3)],
                                 "computer string, technique_id string, risk_score double, n int")
    assert serving.search(rows, {"computer": "%"}, escaped_like=True).count() == 0
    assert serving.search(rows, {"computer": "_"}, escaped_like=True).count() == 1
    assert serving.search(rows, {"computer": "host", "technique_id": "t1"}).count() == 2
    assert serving.min_risk(rows, "oops").count() == 3 and serving.min_risk(rows, "0.5").count() == 1
    assert serving.page_bounds("x", 3) == (100, 0) and serving.page_bounds(5000, -1) == (1000, 0) and serving.page_bounds(0, 2) == (1, 2)
    page = serving.page(rows, [F.desc("n")], 2, 1).collect()
    assert [(r["n"], r["total"]) for r in page] == [(2, 3), (1, 3)]


def test_process_tree_stops_at_cycles(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "LSASS"), (4, 3, "c"), (2, 4, "b"), (9, 8, "z")], "pid int, parent_pid int, name string")
    got = {r["pid"]: (r["depth"], r["intent"]) for r in process_tree.process_tree_closure(rows, rows.filter("pid = 1")).collect()}
    assert got == {1: (0, "WOULD_TERMINATE"), 2: (1, "WOULD_TERMINATE"), 3: (2, "REFUSE_PROTECTED"), 4: (3, "WOULD_TERMINATE")}


def test_deep_process_trees_are_followed_to_their_end(spark):
    chain = [(i, i - 1 if i else None, "p") for i in range(1101)] + [(5000, 5001, "x"), (5001, 5002, "x"), (5002, 5000, "x"), (6000, 5000, "x")]
    rows = spark.createDataFrame(chain, "pid int, parent_pid int, name string")
    got = {r["pid"]: r["depth"] for r in process_tree.process_tree_closure(rows, rows.filter("pid IN (0, 700)")).collect()}
    assert got == {**{i: i for i in range(700)}, **{i: i - 700 for i in range(700, 1101)}}


def test_a_source_under_both_labels_gets_one_split(windows):
    mixed = windows.withColumn("source", F.regexp_replace("source", "attack-[01]", "benign-0")).withColumn("source", F.regexp_replace("source", "attack-2", "benign-4"))
    mixed = mixed.unionByName(windows.filter("label = 1").withColumn("source", F.concat("source", F.lit("-more"))))
    split = S.assign_split(mixed, S.source_split(mixed))
    assert split.count() == mixed.count() and S.leakage(split).count() == 0


def test_key_is_not_in_the_plan(spark):
    df = spark.createDataFrame([("m",)], "m string").select(hmac_sha256(F.col("m"), "open-sesame"))
    pads = [bytes(b ^ x for b in b"open-sesame") for x in (0x36, 0x5C)]
    text = df._jdf.queryExecution().toString().lower()
    assert not any(p.hex() in text or str(p) in text for p in pads) and "open-sesame" not in text


def test_missing_profile_of_no_rows(spark):
    rows = profiling.missing_profile(spark.createDataFrame([], "a int, b string")).collect()
    assert sorted(tuple(r) for r in rows) == [("a", 0, None), ("b", 0, None)]


def test_chi_square_of_a_tiny_case(spark):
    shown = spark.createDataFrame([(1, "f"), (2, "f"), (3, "f")], "sample_id int, name string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "sample_id int, label int")
    row = selection.chi_square(shown, labels).first()
    assert row["chi2"] == pytest.approx(1 / 3) and row["df"] == 1 and row["p_value"] == pytest.approx(0.5637, abs=1e-4)
    absent = selection.with_absent(selection.chi_square(shown, labels), spark.createDataFrame([("f",), ("g",)], "name string"), p_value=float("nan"))
    assert [r["name"] for r in selection.pvalue_filter(absent).collect()] == ["g"]
    assert selection.mutual_information(shown, labels).first()["mi"] == pytest.approx(0.2157, abs=1e-4)


def test_joined_groups_must_not_share_columns(spark):
    a = spark.createDataFrame([(1, 1)], "sample_id int, x int")
    with pytest.raises(ValueError):
        presence.selected_matrix_inner_join([a, a])


def test_imputation_ties_take_the_smallest(spark):
    rows = spark.createDataFrame([("f", "s", 1, "b"), ("f", "s", 1, "a"), ("f", "s", 1, None), ("g", "s2", 1, None), ("", "s", 0, None)],
                                 "ransomware_family string, source string, sample_type int, d string")
    filled = profiling.mode_impute(rows, "d").collect()
    assert sorted(r["d"] for r in filled) == ["2021-02-04", "a", "a", "a", "b"]


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [0.5, 0.5, 0.5, 9.0], [float(i * i % 37) for i in range(101)]])
def test_quantile_equals_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
    for share in (0.0, 0.5, 0.95, 1.0):
        assert M.quantile(df, "x", share) == pytest.approx(np.quantile(values, share), abs=1e-12)
