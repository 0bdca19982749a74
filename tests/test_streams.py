"""Streams fed in several micro-batches against their batch twins."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.operators import episodes, models as M, sequence_model as SM, telemetry as T
from palisade.streaming import live


def write_parts(frames, folder):
    """One Parquet file per frame, oldest first."""
    os.makedirs(folder)
    for i, frame in enumerate(frames):
        path = f"{folder}/{i:03d}.parquet"
        frame.to_parquet(path, coerce_timestamps="us", index=False)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def run(stream, tmp_path, name):
    path = str(tmp_path / name)
    live.append(stream, path, str(tmp_path / f"{name}-state"), available_now=True).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(11)
    n = 900
    seconds = np.sort(rng.integers(0, 600, n))
    return pd.DataFrame({
        "timestamp": pd.Timestamp("2026-01-01", tz="UTC") + pd.to_timedelta(seconds, unit="s") + pd.to_timedelta(np.arange(n), unit="us"),
        "event_id": rng.choice(["1", "3", "11", "13", "22"], n), "computer": np.where(rng.random(n) < 0.4, "hot", "pc"),
        "process_guid": np.char.add("p", rng.integers(0, 3, n).astype(str)), "process_id": "7", "image": "i.exe",
        "target_filename": np.char.add("C:\\Temp\\f", rng.integers(0, 30, n).astype(str)), "destination_ip": ""})


def test_windows_equal_the_batch_and_ignore_rereads(spark, events, tmp_path):
    parts = [events[:300], pd.concat([events[250:300], events[300:600]]), events[600:]]  # the second file repeats rows
    write_parts(parts, f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = live.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    got = run(live.stream_process_windows(stream, "20 seconds", 5), tmp_path, "windows")
    batch = T.process_windows(T.event_filter(spark.createDataFrame(events)), 5)
    closed = events["timestamp"].max() - pd.Timedelta(seconds=25)
    want = batch.filter(F.col("window_start") <= F.lit(closed.floor("ms").tz_localize(None).isoformat()).cast("timestamp"))
    assert got.count() == want.count() > 100
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_late_rows_are_counted(spark, events, tmp_path):
    write_parts([events[300:600], events[600:], events[:100]], f"{tmp_path}/in")  # a watermark counts from the batch after next
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = live.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    query = live.append(live.stream_process_windows(stream, "10 seconds", 5), f"{tmp_path}/out", f"{tmp_path}/state", available_now=True)
    counter = live.LateRows(query, seconds=0.05)
    query.awaitTermination()
    assert counter.total() == 100  # events, not what they are split into


def test_bursts_and_hosts_count_as_in_the_batch(spark, events, tmp_path):
    """Different files of one process at one instant, and the same process number at the same instant on two hosts, are different events."""
    burst = events[events["event_id"].astype(str) == "11"][:1]
    burst = pd.concat([burst.assign(target_filename=f"C:/f{i}.doc", computer=c) for i in range(3) for c in ("one", "two")], ignore_index=True)
    clock = events[-1:].assign(timestamp=events["timestamp"].max() + pd.Timedelta(hours=2))
    write_parts([pd.concat([burst, burst[:2]]), clock], f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = live.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    got = run(live.stream_process_windows(stream, "20 seconds", 5), tmp_path, "windows").collect()
    assert sorted((r["computer"], r["event_count"], r["unique_files"]) for r in got) == [("one", 3, 3), ("two", 3, 3)]


def test_incidents_may_come_out_of_order(spark, tmp_path):
    times = pd.Timestamp("2026-01-01", tz="UTC") + pd.to_timedelta([60, 0, 0, 60], unit="s")
    frame = pd.DataFrame({"computer": "pc", "process_key": ["a", "b", "c", "d"], "window_start": times, "event_count": 40, "file_activity_count": 9,
                          "registry_activity_count": 0, "technique_id": "T1486"})
    write_parts([frame[:1], frame[1:2], frame[2:]], f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    model = SM.SequenceModel(M.Scaler(("event_count",), (0.0,), (1.0,)), (1.0,), (1.0,), 9.0)
    stream = live.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    got = run(live.stream_alerts(stream, model, 0.8), tmp_path, "alerts").collect()
    assert sorted((r["process_key"], r["alert_created"]) for r in got) == [("a", True), ("b", True), ("c", False), ("d", False)]


def test_heartbeat_reports_silence_and_return(spark, tmp_path):
    def at(*seconds):
        return pd.DataFrame({"computer": "pc", "timestamp": pd.Timestamp("2026-01-01", tz="UTC") + pd.to_timedelta(list(seconds), unit="s")})
    clock = at(200).assign(computer="other")
    write_parts([at(0, 5, 10, 12), clock, pd.concat([at(300, 301), at(400).assign(computer="other")])], f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = live.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    rows = run(live.stream_heartbeat(stream, "1 second", 30), tmp_path, "beat").filter("computer = 'pc'").collect()
    told = sorted((r["last_event"].second + 60 * r["last_event"].minute, r["status"], r["gap_seconds"], r["total_events"]) for r in rows)
    assert (12, "SENSOR_SILENCED", None, 4) in told and (12, "HEALTHY", 288.0, 4) in told


def scored_frame():
    rng = np.random.default_rng(5)
    rows = [(h, f"p{i % 4}:{100 + i % 4}", pd.Timestamp("2026-01-01", tz="UTC") + pd.Timedelta(seconds=5 * (i // 2)), int(rng.integers(0, 40)),
             int(rng.integers(0, 6)), "benign" if i % 9 == 0 else "T1486", float(np.round(rng.beta(0.7, 0.7), 3)))
            for h, n in (("hot", 240), ("pc", 50)) for i in range(n)]
    frame = pd.DataFrame(rows, columns=["computer", "process_key", "window_start", "event_count", "file_activity_count", "technique_id", "risk_score"])
    return frame.assign(registry_activity_count=0).sort_values(["window_start", "computer", "process_key"], kind="stable").reset_index(drop=True)


def test_alerts_keep_history_across_batches(spark, tmp_path):
    frame = scored_frame()
    cuts = [0, 100, 130, len(frame)]
    write_parts([frame[a:b] for a, b in zip(cuts, cuts[1:])], f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    features = ("event_count", "file_activity_count")
    model = SM.SequenceModel(M.Scaler(features, (20.0, 3.0), (12.0, 2.0)), (0.5, -0.2), (0.6, 0.3), 0.4)
    stream = live.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    got = run(live.stream_alerts(stream, model, 0.8), tmp_path, "alerts").toPandas()
    batch = SM.sequence_score(spark.createDataFrame(frame.drop(columns="risk_score")), model).toPandas()
    key = ["computer", "window_start", "process_key"]
    both = got.merge(batch[[*key, "risk_score", "technique_id"]], on=key, suffixes=("", "_batch"))
    assert len(both) == len(frame)
    original = frame.set_index(key)
    for row in both.itertuples():
        source = original.loc[(row.computer, row.window_start.tz_localize("UTC"), row.process_key)]
        quiet = row.technique_id == "benign" or (source.event_count < 15 and source.file_activity_count < 3)
        assert row.risk_score == pytest.approx(0.0 if quiet else row.risk_score_batch)
    raised = both[both.risk_score >= 0.8]
    assert len(raised) and both[both.alert_created].groupby(["computer", "window_start"]).size().eq(1).all()
    assert both.alert_created.sum() == raised.groupby(["computer", "window_start"]).ngroups


def test_escalation_equals_the_batch(spark, tmp_path):
    frame = scored_frame()
    cuts = [0, 90, 91, 200, len(frame)]
    write_parts([frame[a:b] for a, b in zip(cuts, cuts[1:])], f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = live.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    changes = run(live.stream_escalation(stream), tmp_path, "levels").toPandas()
    changes["direct"] = (changes["change"] == "OPENED") & (changes["status"] == "ACTIVE")  # opened by a critical score
    latest = changes.sort_values("change").groupby(["computer", "episode", "opened_at", "direct"], as_index=False).last()  # UPGRADED last
    batch = episodes.escalation_episodes(spark.createDataFrame(frame)).toPandas()
    key = ["computer", "episode", "opened_at", "risk_score", "status"]
    got, want = ({tuple(map(str, r)) for r in d[key].itertuples(index=False)} for d in (latest, batch))
    assert got == want and len(got) > 20


def test_each_alert_is_handed_over_once(spark, tmp_path):
    times = pd.Timestamp("2026-01-01", tz="UTC") + pd.to_timedelta([0, 5, 10], unit="s")
    frame = pd.DataFrame({"computer": "pc", "process_key": ["a:11", "b:22", "c"], "window_start": times, "risk_score": [0.12, 0.95, 0.9]})
    again = frame.assign(risk_score=0.99)
    write_parts([pd.concat([frame, frame.assign(computer="other")]), again], f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = live.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    known = spark.createDataFrame(frame[2:].rename(columns={"window_start": "alert_id"})[["alert_id", "computer"]])
    got = run(live.alert_handoff(stream, ignored=known), tmp_path, "intents")
    rows = sorted((r["computer"], r["risk_score"], r["process_id"], r["terminate_tree"], r["mode"]) for r in got.collect())
    want = [("other", 0.12, None, False), ("other", 0.9, None, False), ("other", 0.95, 22, True), ("pc", 0.12, None, False), ("pc", 0.95, 22, True)]
    assert rows == [(*w, "dry_run") for w in want]  # pc's last alert was there at the start


def test_incidents_are_forgotten_behind_the_horizon(spark, tmp_path):
    """The same window comes again: within the horizon it raises nothing, later it does, and its state entry is gone in between."""
    def at(second, process):
        return pd.DataFrame({"computer": "pc", "process_key": [process], "window_start": pd.Timestamp("2026-01-01", tz="UTC") + pd.to_timedelta([second], unit="s"),
                             "event_count": 40, "file_activity_count": 9, "registry_activity_count": 0, "technique_id": "T1486"})
    write_parts([at(0, "a"), at(50, "b"), at(0, "c"), at(200, "d"), at(0, "e")], f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    model = SM.SequenceModel(M.Scaler(("event_count",), (0.0,), (1.0,)), (1.0,), (1.0,), 9.0)
    stream = live.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    got = run(live.stream_alerts(stream, model, 0.8, horizon=100), tmp_path, "alerts").collect()
    assert sorted((r["process_key"], r["alert_created"]) for r in got) == [("a", True), ("b", True), ("c", False), ("d", True), ("e", True)]
    kept = spark.read.parquet(f"{tmp_path}/alerts-state/ordered/raised/3").collect()
    start = int(pd.Timestamp("2026-01-01", tz="UTC").timestamp())
    assert [(r["computer"], r["window_us"] // 1_000_000 - start) for r in kept] == [("pc", 200)]
    assert sorted(os.listdir(f"{tmp_path}/alerts-state/ordered/raised")) == ["3", "4"]  # earlier states are removed


def test_a_hot_host_spreads_and_carries_its_level(spark, tmp_path):
    """Most rows on one host, many pieces, borders of batches inside episodes."""
    rng = np.random.default_rng(8)
    n = 6000
    frame = pd.DataFrame({"computer": np.where(rng.random(n) < 0.8, "hot", np.char.add("pc", rng.integers(0, 40, n).astype(str))),
                          "process_key": np.char.add("p", np.arange(n).astype(str)), "risk_score": np.round(rng.beta(0.9, 0.5, n), 3),
                          "window_start": pd.Timestamp("2026-01-01", tz="UTC") + pd.to_timedelta(np.sort(rng.integers(0, n, n)), unit="s")})
    cuts = [0, 1, 700, 701, 4000, n]
    write_parts([frame[a:b].sample(frac=1, random_state=1) for a, b in zip(cuts, cuts[1:])], f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = live.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    got = run(live.stream_escalation(stream), tmp_path, "levels").collect()
    want, state = set(), {}
    parts = [frame[a:b].sort_values(["window_start", "process_key"]) for a, b in zip(cuts, cuts[1:])]
    for r in pd.concat(parts).itertuples():  # one row after the other
        warned, critical, opened, episode = state.get(r.computer, (False, False, None, 0))
        if r.risk_score < 0.2:
            warned, critical, opened, episode = False, False, None, episode + 1
        elif 0.6 <= r.risk_score < 0.85 and not warned:
            warned, opened = True, r.window_start
            want.add((r.computer, episode, "OPENED", str(opened)[:19], str(r.window_start)[:19], r.risk_score, "MONITORING"))
        elif r.risk_score >= 0.85 and not critical:
            critical, kind = True, "UPGRADED" if warned else "OPENED"
            opened = opened or r.window_start
            want.add((r.computer, episode, kind, str(opened)[:19], str(r.window_start)[:19], r.risk_score, "ACTIVE"))
        state[r.computer] = warned, critical, opened, episode
    names = ("computer", "episode", "change", "opened_at", "changed_at", "risk_score", "status")
    assert len(got) == len(want) > 500
    assert {tuple(str(r[n]) if n.endswith("_at") else r[n] for n in names) for r in got} == want


def test_handed_over_alerts_are_forgotten(spark, tmp_path):
    """The alert of second 0 comes again within the horizon, then behind it."""
    def at(second, process):
        return pd.DataFrame({"computer": "pc", "process_key": [process], "risk_score": [0.95],
                             "window_start": pd.Timestamp("2026-01-01", tz="UTC") + pd.to_timedelta([second], unit="s")})
    write_parts([at(0, "a:1"), at(0, "b:2"), at(200, "c:3"), at(0, "d:4")], f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = live.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    assert sorted(r["process_id"] for r in run(live.alert_handoff(stream, kept=100), tmp_path, "intents").collect()) == [1, 3, 4]
