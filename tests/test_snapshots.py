"""Tables replaced as a whole under their readers."""

import pytest
from pyspark.sql import functions as F

from palisade.sources import snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(spark, data):
    return spark.createDataFrame(data, "k long, part string, v long")


def test_readers_see_old_or_new(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert snapshots.read_snapshot(spark, root) is None and snapshots.versions(spark, root) == []
    assert snapshots.publish(made(spark, [(1, "a", 1)]), root) == 1
    old = snapshots.read_snapshot(spark, root)
    assert snapshots.publish(made(spark, [(1, "a", 2), (2, "b", 3)]), root, ("part",)) == 2
    assert rows(old) == [(1, "a", 1)] and rows(snapshots.read_snapshot(spark, root).select("k", "part", "v")) == [(1, "a", 2), (2, "b", 3)]
    assert snapshots.publish(made(spark, []), root) == 3 and snapshots.read_snapshot(spark, root).count() == 0
    assert snapshots.expire(spark, root, keep=2) == 1 and [n for n, _ in snapshots.versions(spark, root)] == [2, 3]
    assert snapshots.expire(spark, root, keep=2) == 0 and snapshots.read_snapshot(spark, root).count() == 0


def test_a_failed_refresh_changes_nothing(spark, tmp_path):
    root = f"{tmp_path}/t"
    snapshots.publish(made(spark, [(1, "a", 1)]), root)
    broken = made(spark, [(1, "a", 5), (2, "b", 6)]).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        snapshots.publish(broken, root)
    assert rows(snapshots.read_snapshot(spark, root)) == [(1, "a", 1)]
    assert snapshots.publish(made(spark, [(9, "a", 1)]), root) == 2


def test_upsert_by_key_twice(spark, tmp_path):
    root = f"{tmp_path}/t"
    keys = ("k", "part")
    assert snapshots.upsert(made(spark, [(1, "a", 1), (2, None, 2), (None, "a", 3)]), root, keys) == 1
    late = made(spark, [(2, None, 20), (None, "a", 30), (3, "c", 4)])
    want = sorted([(1, "a", 1), (2, None, 20), (None, "a", 30), (3, "c", 4)], key=repr)
    for _ in range(2):
        snapshots.upsert(late, root, keys)
        assert rows(snapshots.read_snapshot(spark, root)) == want
    snapshots.upsert(made(spark, [(3, "c", 99), (4, "d", 5)]), root, keys, replace=False)  # stored rows win
    assert rows(snapshots.read_snapshot(spark, root)) == sorted([*want, (4, "d", 5)], key=repr)


def test_two_jobs_at_once(spark, tmp_path):
    root = f"{tmp_path}/t"
    snapshots.publish(made(spark, [(1, "a", 1)]), root)
    real = snapshots.versions
    with pytest.MonkeyPatch.context() as patch:
        def first_then_other(session, where):
            known = real(session, where)
            patch.setattr(snapshots, "versions", real)
            snapshots.publish(made(session, [(7, "z", 7)]), where)  # commits between the look and the commit
            return known
        patch.setattr(snapshots, "versions", first_then_other)
        with pytest.raises(snapshots.ConcurrentRefresh):
            snapshots.upsert(made(spark, [(1, "a", 2)]), root, ("k",))
    assert rows(snapshots.read_snapshot(spark, root)) == [(7, "z", 7)]


def test_explanations_are_stored_once(spark, tmp_path):
    from palisade.operators.attribution import store_explanations
    made = lambda data: spark.createDataFrame(data, "alert_id long, feature_name string, importance_value double")
    root = f"{tmp_path}/x"
    store_explanations(made([(1, "a", 0.5)]), root)
    for _ in range(2):
        got = rows(store_explanations(made([(1, "a", 9.0), (1, "b", 9.0), (2, "a", 0.1), (2, "b", 0.2)]), root))
        assert got == [(1, "a", 0.5), (2, "a", 0.1), (2, "b", 0.2)]
