"""Many logistic fits in one scan, against dense Newton steps in numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.operators import logistic_fits as LF
from palisade.operators import models as M
from palisade.operators.logistic_fits import Fit, fit_many, moments, predicted
from palisade.operators.splits import stratified_folds
from palisade.session import durable


def newton(x, y, w, penalty, classes=2, rounds=60):
    """Coefficients and intercept of the penalised mean loss; softmax by plain Newton with a full matrix."""
    lines, n = (1, len(y)) if classes == 2 else (classes, len(y))
    z1 = np.hstack([x, np.ones((n, 1))])
    theta, keep = np.zeros((lines, z1.shape[1])), np.append(np.full(x.shape[1], penalty), 0.0)
    want = y[:, None] if lines == 1 else np.eye(classes)[y.astype(int)]
    for _ in range(rounds):
        z = z1 @ theta.T
        p = 1 / (1 + np.exp(-z)) if lines == 1 else np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
        g = ((p - want) * w[:, None]).T @ z1 / w.sum() + keep * theta
        size = z1.shape[1]
        h = np.zeros((lines * size, lines * size))
        for a in range(lines):
            for b in range(lines):
                c = p[:, a] * ((a == b) - p[:, b])
                h[a * size:(a + 1) * size, b * size:(b + 1) * size] = (z1 * (w * c)[:, None]).T @ z1 / w.sum() + (a == b) * np.diag(keep)
        theta -= np.linalg.lstsq(h, g.ravel(), rcond=None)[0].reshape(theta.shape)
    return theta


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 5)) * [1, 10, 0.1, 3, 1] + [0, 50, 0, -3, 0]
    y = (x[:, 0] + 0.1 * (x[:, 1] - 50) + draw.normal(size=400) > 0.3).astype(int)
    group = draw.integers(0, 3, 400)
    rows = spark.createDataFrame([(int(a), [float(v) for v in r], int(g)) for a, r, g in zip(y, x, group)], "y int, x array<double>, g int").repartition(5)
    return durable(rows), x, y, group


def test_each_model_equals_a_single_fit(data):
    rows, x, y, group = data
    weigh = lambda b: np.stack([np.where(b.column("g").to_numpy() == k, 0.0, 1.0 + k * b.column("y").to_numpy()) for k in range(3)])
    counts, means, deviations = moments(rows, 5, 3, weigh)
    fits = [Fit(0.01 * (k + 1), mean=means[k], deviation=deviations[k]) for k in range(3)]
    tables = fit_many(rows, 5, fits, weigh)
    alone = fit_many(rows, 5, fits[1:2], lambda b: weigh(b)[1:2])[0]
    assert np.abs(alone - tables[1]).max() < 1e-6
    for k in range(3):
        inside = group != k
        assert counts[k].tolist() == [(y[inside] == 0).sum(), (y[inside] == 1).sum()]
        scaled = (x[inside] - x[inside].mean(0)) / x[inside].std(0)
        want = newton(scaled, y[inside].astype(float), 1.0 + k * y[inside], 0.01 * (k + 1))
        assert np.abs(tables[k] - want).max() < 1e-6


def test_masks_starts_and_no_rows(data, spark):
    rows, x, y, _ = data
    used = np.array([True, False, True, False, True])
    ones = lambda b: np.ones((1, b.num_rows))
    cold = fit_many(rows, 5, [Fit(0.1, used)], ones)[0]
    want = newton(x[:, used], y.astype(float), np.ones(400), 0.1)
    assert (cold[:, [1, 3]] == 0).all() and np.abs(cold[:, [0, 2, 4, 5]] - want).max() < 1e-6
    assert np.abs(fit_many(rows, 5, [Fit(0.1, used, start=cold + 1)], ones)[0] - cold).max() < 1e-6
    assert (fit_many(rows.limit(0), 5, [Fit(0.1)], ones)[0] == 0).all()
    assert (fit_many(rows, 5, [Fit(0.1)], lambda b: np.zeros((1, b.num_rows)))[0] == 0).all()


def test_sums_of_many_tasks_are_added_in_groups(data, monkeypatch):
    from palisade.operators import logistic_fits as L
    rows, x, y, _ = data
    direct = fit_many(rows, 5, [Fit(0.1)] * 2, lambda b: np.ones((2, b.num_rows)))
    monkeypatch.setattr(L, "_DIRECT", 0)
    monkeypatch.setattr(L, "_SLICE", 4)
    grouped = fit_many(rows, 5, [Fit(0.1)] * 2, lambda b: np.ones((2, b.num_rows)))
    want = newton(x, y.astype(float), np.ones(400), 0.1)
    assert all(np.abs(t - want).max() < 1e-6 for t in (*direct, *grouped))


def test_places_and_several_classes(spark):
    draw = np.random.default_rng(9)
    x = (draw.random((500, 30)) < 0.2).astype(float)
    y = np.argmax(x[:, :4] * 3 + draw.gumbel(size=(500, 4)), 1)
    rows = durable(spark.createDataFrame([(int(a), np.flatnonzero(r).tolist()) for a, r in zip(y, x)], "y int, places array<int>").repartition(4))
    table = fit_many(rows, 30, [Fit(0.02)], lambda b: np.ones((1, b.num_rows)), classes=4)[0]
    want = newton(x, y, np.ones(500), 0.02, classes=4)
    assert np.abs(table[:, :30] - want[:, :30]).max() < 1e-6
    told = predicted(rows, 30, [table], ["y"], lambda b: np.ones((1, b.num_rows), bool)).collect()
    assert len(told) == 500 and all(abs(sum(r.scores) - 1) < 1e-9 and r.predicted == int(np.argmax(r.scores)) for r in told)


def test_one_round_of_elimination_equals_brute_force(spark):
    draw = np.random.default_rng(5)
    x = (draw.random((300, 20)) < 0.3).astype(float)
    y = (x[:, :5].sum(1) + 0.5 * draw.normal(size=300) > 1.5).astype(int)
    rows = durable(spark.createDataFrame([(int(a), np.flatnonzero(r).tolist()) for a, r in zip(y, x)], "y int, places array<int>"))
    first = newton(x, y.astype(float), np.ones(300), 1 / 300)[0, :20]
    kept = M.eliminate(rows, 20, [18, 10, 5], step=0.1)
    assert kept[18] == sorted(np.argsort(first ** 2, kind="stable")[2:].tolist()) and kept[5] == [0, 1, 2, 3, 4] and set(kept[5]) < set(kept[10]) < set(kept[18])


def test_folds_are_stratified_and_search_uses_them(spark):
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    folds = stratified_folds(rows, "id", "y", 3)
    counts = {(r["y"], r["fold"]): r["n"] for r in folds.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(max(counts[y, f] for f in range(3)) - min(counts[y, f] for f in range(3)) <= 1 for y in (0, 1))
    assert sorted(map(tuple, folds.collect())) == sorted(map(tuple, stratified_folds(rows.repartition(7), "id", "y", 3).collect()))
    seen = folds.withColumn("places", F.when(F.col("y") == 1, F.array(F.lit(0), (F.col("id") % 5 + 1).cast("int"))).otherwise(F.array((F.col("id") % 5 + 1).cast("int"))))
    best, table, figures = M.logistic_search(durable(seen), 6, 2)
    assert {r["strength"]: r["figure"] for r in figures.collect()}[best] == 1.0 and table[0, 0] > 0


def test_moments_of_weighted_rows(spark):
    draw = np.random.default_rng(3)
    x, n, y = draw.normal(5, 2, (40, 3)), draw.integers(0, 5, 40), draw.integers(0, 2, 40)
    rows = spark.createDataFrame([(int(c), v.tolist(), int(k)) for c, v, k in zip(y, x, n)], "y int, x array<double>, n int").repartition(3)
    counts, means, deviations = moments(rows, 3, 1, lambda b: b.column("n").to_numpy()[None, :], "n")
    every, classes = np.repeat(x, n, 0), np.repeat(y, n)
    assert counts[0].tolist() == [(classes == 0).sum(), (classes == 1).sum()]
    assert np.allclose(means[0], every.mean(0)) and np.allclose(deviations[0], every.std(0))


def test_full_and_sparse_tables_give_the_same_sums():
    """Products of whole 0/1 tables and sums over places: the same answers and gradients, and full tables take the products."""
    draw = np.random.default_rng(4)
    x = draw.random((50, 40)) < 0.3
    batch = pa.RecordBatch.from_arrays([pa.array([np.flatnonzero(r).tolist() for r in x], pa.list_(pa.int32()))], ["places"])
    tables, off = draw.normal(size=(3, 4, 41)), draw.normal(size=(12, 50))
    want, whole = LF._answers(batch, 40, tables)
    assert "x" in whole.__code__.co_freevars
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(LF, "_SPARSE", 0)
        got, back = LF._answers(batch, 40, tables)
    assert "places" in back.__code__.co_freevars and np.allclose(want, got) and np.allclose(whole(off), back(off))


def test_a_matrix_reads_the_names_once(spark):
    """Names are made once, of labelled samples only, however often the matrix needs them."""
    from palisade.plans import matrix_models as MM
    made = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    plain = durable(spark.createDataFrame([(i, f"n{j}") for i in range(40) for j in range(i % 3 + 1)], "sample_id long, name string"))
    labels = spark.createDataFrame([(i, int(i % 3 == 2)) for i in range(30)], "sample_id long, label int")
    splits = labels.select("sample_id", F.when(F.col("sample_id") < 24, "train").otherwise("test").alias("split"))
    data = MM.matrix(plain.mapInArrow(told, plain.schema), labels, splits)
    assert data.names == ("n1", "n2") and data.rows.count() == 30 and made.value == plain.count()


def test_few_names_are_dealt_to_several_tasks(spark, monkeypatch):
    """The rows of a task follow the number of names, so a matrix of few names and many samples is not one task."""
    from palisade.plans import matrix_models as MM
    assert MM._PLACES[0] < MM._PLACES[1]
    monkeypatch.setattr(MM, "_PLACES", (100, 1 << 20))
    plain = spark.range(400).select(F.col("id").alias("sample_id"), F.explode(F.when(F.col("id") % 3 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c")))).alias("name"))
    labels = spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") % 3 == 2).cast("int").alias("label"))
    splits = labels.select("sample_id", F.when(F.col("sample_id") < 300, "train").otherwise("test").alias("split"))
    data = MM.matrix(plain, labels, splits)
    assert data.names == ("a", "b", "c") and data.rows.count() == 400
    assert data.rows.select(F.input_file_name()).distinct().count() == 3  # 533 places, 192 a task
