"""Many penalised logistic models over the same rows, fitted together: one scan a step, however many models there are.

Each model has its own row weights (0: not a training row), penalty, scaling and set of places in use. All models walk in step: a scan adds up
the loss and the gradient of every unfinished model at its own point, and the driver moves each by limited-memory quasi-Newton steps.
Rows hold ``y`` (the class number) and either ``x array<double>`` or, for 0/1 features, ``places array<int>``, those that are 1. A task keeps the models'
sums only; they are cut into slices for the addition, so no group grows with models times features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SLICE = 1024  # numbers that are added up in one group
_SPARSE = 64  # a 0/1 table with fewer than one place in so many set is summed place by place
_BLOCK = 1 << 22  # numbers of such a table that are spread out at once
_DIRECT = 1 << 22  # numbers that the driver adds up itself, all tasks' sums together


@dataclass(frozen=True)
class Fit:
    """What sets a model apart: the penalty on half the squared coefficients of the mean loss, places in use (all, if None), scaling, first point."""

    penalty: float
    used: np.ndarray | None = None
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None
    start: np.ndarray | None = None


class Descent:
    """Limited-memory quasi-Newton steps for a smooth convex function, one value and gradient at a time."""

    def __init__(self, start: np.ndarray, tolerance: float, memory: int = 12) -> None:
        self.trial, self.tolerance, self.memory = start, tolerance, memory
        self.at, self.value, self.slope, self.way, self.step = None, np.inf, None, None, 1.0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.done = False

    def told(self, value: float, gradient: np.ndarray) -> None:
        """Take the value at ``trial``; ``trial`` is then the next point, unless ``done``."""
        if self.at is not None:
            falls = self.step * float(self.way @ self.slope)
            if not value <= self.value + 1e-4 * falls + 1e-13 * abs(self.value):
                self.step *= 0.5 if not np.isfinite(value) else max(0.1, min(0.5, -falls / (2 * (value - self.value - falls))))
                self.done = self.step < 1e-12
                self.trial = self.at if self.done else self.at + self.step * self.way
                return
            moved, turned = self.trial - self.at, gradient - self.slope
            if moved @ turned > 1e-14 * (moved @ moved):
                self.pairs = [*self.pairs, (moved, turned)][-self.memory:]
        self.at, self.value, self.slope = self.trial, value, gradient
        if np.abs(gradient).max(initial=0) <= self.tolerance:
            self.done = True
            return
        way, sums = -gradient, []
        for moved, turned in reversed(self.pairs):
            share = moved @ way / (moved @ turned)
            way = way - share * turned
            sums.append(share)
        if self.pairs:
            moved, turned = self.pairs[-1]
            way = way * (moved @ turned) / (turned @ turned)
        for (moved, turned), share in zip(self.pairs, reversed(sums)):
            way = way + (share - turned @ way / (moved @ turned)) * moved
        if way @ gradient >= 0:
            self.pairs, way = [], -gradient
        self.way, self.step = way, 1.0 if self.pairs else min(1.0, 1.0 / np.abs(gradient).sum())
        self.trial = self.at + self.step * self.way


class Lists:
    """A list column as flat values and the row of each."""

    def __init__(self, column: pa.ListArray) -> None:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        self.values, self.row = column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _answers(batch: pa.RecordBatch, size: int, tables: np.ndarray) -> tuple[np.ndarray, Callable]:
    """Sums of each of ``tables[model, class, size + 1]`` for each row, as ``[model, class, row]``, and what turns residuals into gradients."""
    n, names = batch.num_rows, batch.schema.names
    flat = tables.reshape(-1, size + 1)
    if "x" in names:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, size)
        z = flat[:, :size] @ x.T + flat[:, size:]

        def back(off: np.ndarray) -> np.ndarray:
            return np.concatenate([off @ x, off.sum(1, keepdims=True)], 1)
    else:
        places = Lists(batch.column("places"))
        if len(places.values) * _SPARSE > n * size:  # so full that products of whole tables are faster than sums over the places
            x = np.zeros((n, size))
            x[places.row, places.values] = 1.0
            z = flat[:, :size] @ x.T + flat[:, size:]
            return z.reshape(len(tables), -1, n), lambda off: np.concatenate([off @ x, off.sum(1, keepdims=True)], 1)
        z = np.stack([np.bincount(places.row, t[places.values], n) + t[size] for t in flat]) if n else np.zeros((len(flat), 0))

        def back(off: np.ndarray) -> np.ndarray:
            return np.stack([np.append(np.bincount(places.values, o[places.row], size), o.sum()) for o in off])
    return z.reshape(len(tables), -1, n), back


def _rows_at_once(size: int) -> int:
    return max(1, min(4096, _BLOCK // max(size, 1)))


def _losses(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss by model and row, and its slope by model, class and row; one sum a row stands for two classes."""
    if z.shape[1] == 1:
        one = z[:, 0]
        return np.logaddexp(0, one) - y * one, (1 / (1 + np.exp(-np.clip(one, -500, 500))) - y)[:, None]
    top = z - z.max(1, keepdims=True)
    log = top - np.log(np.exp(top).sum(1, keepdims=True))
    rows = np.arange(len(y))
    slope = np.exp(log)
    slope[:, y.astype(int), rows] -= 1
    return -log[:, y.astype(int), rows], slope


def fit_many(rows: DataFrame, size: int, fits: Sequence[Fit], weigh: Callable[[pa.RecordBatch], np.ndarray], classes: int = 2, tolerance: float = 1e-8,
             steps: int = 1000) -> list[np.ndarray]:
    """Coefficients of each model as ``[class, size + 1]`` over scaled features, the intercept last; with two classes there is one line.

    ``rows`` has ``y``, ``x`` or ``places``, and what else ``weigh`` reads; write it out (``durable``) first, it is read once a step. ``weigh`` gives the weights
    of a batch's rows as ``[model, row]``. Minimised is the weighted mean loss plus ``penalty / 2`` times the squared coefficients, intercepts free;
    places not in use and those of models without weight stay 0. Done is a model whose gradient is nowhere above ``tolerance``.
    """
    lines = 1 if classes == 2 else classes
    shape = (lines, size + 1)
    used = [np.append(np.ones(size, bool) if f.used is None else f.used, True) for f in fits]
    means = [np.zeros(size) if f.mean is None else f.mean for f in fits]
    scales = [np.ones(size) if f.deviation is None else f.deviation for f in fits]
    walks = [Descent(np.zeros(shape)[:, u].ravel() if f.start is None else np.asarray(f.start, float)[:, u].ravel(), tolerance) for f, u in zip(fits, used)]

    def whole(k: int, point: np.ndarray) -> np.ndarray:
        table = np.zeros(shape)
        table[:, used[k]] = point.reshape(lines, -1)
        return table

    def values(active: list[int]) -> dict[int, np.ndarray]:
        """For each active model the sum of losses, of weights and of gradients over unscaled features."""
        tables = np.stack([whole(k, walks[k].trial) for k in active])
        raw = tables.copy()
        for i, k in enumerate(active):
            raw[i, :, :size] /= scales[k]
            raw[i, :, size] -= raw[i, :, :size] @ means[k]

        def scan(batches: Iterator) -> Iterator:
            total = np.zeros((len(active), 2 + lines * (size + 1)))
            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    some = batch.slice(at, block)
                    z, back = _answers(some, size, raw)
                    loss, slope = _losses(z, some.column("y").to_numpy(zero_copy_only=False).astype(float))
                    weight = weigh(some)[active]
                    total[:, 0] += (weight * loss).sum(1)
                    total[:, 1] += weight.sum(1)
                    total[:, 2:] += back((slope * weight[:, None]).reshape(-1, some.num_rows)).reshape(len(active), -1)
            cuts = range(0, total.shape[1], _SLICE)
            parts = [total[i, a:a + _SLICE] for i in range(len(active)) for a in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([k for k in active for _ in cuts], pa.int32()), pa.array(list(range(len(cuts))) * len(active), pa.int32()),
                                              pa.array([x.tobytes() for x in parts], pa.binary())], ["model", "part", "sums"])

        def added(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py()) for x in group.column("sums"))
            return group.slice(0, 1).select(["model", "part"]).append_column("sums", pa.array([total.tobytes()], pa.binary()))

        schema = "model int, part int, sums binary"
        found = rows.mapInArrow(scan, schema)
        if tasks * len(active) * (2 + lines * (size + 1)) > _DIRECT:
            found = found.groupBy("model", "part").applyInArrow(added, schema)
        sums: dict[tuple[int, int], np.ndarray] = {}
        for r in found.collect():
            place = r["model"], r["part"]
            sums[place] = sums.get(place, 0) + np.frombuffer(r["sums"])
        return {k: np.concatenate([sums[p] for p in sorted(p for p in sums if p[0] == k)]) for k in {p[0] for p in sums}}

    tasks, block = rows.rdd.getNumPartitions(), _rows_at_once(size)
    for _ in range(steps):
        active = [k for k, w in enumerate(walks) if not w.done]
        if not active:
            break
        found = values(active)
        for k in active:
            total = found.get(k)
            if total is None or not total[1]:
                walks[k].done, walks[k].at = True, np.zeros_like(walks[k].trial)
                continue
            table, gradient = whole(k, walks[k].trial), total[2:].reshape(shape) / total[1]
            gradient[:, :size] = (gradient[:, :size] - gradient[:, size:] * means[k]) / scales[k] + fits[k].penalty * table[:, :size]
            walks[k].told(total[0] / total[1] + fits[k].penalty / 2 * (table[:, :size] ** 2).sum(), gradient[:, used[k]].ravel())
    return [whole(k, w.trial if w.at is None else w.at) for k, w in enumerate(walks)]


def moments(rows: DataFrame, size: int, models: int, weigh: Callable[[pa.RecordBatch], np.ndarray],
            times: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (by ``y`` 0 and not 0), means and population deviations of ``x`` over each model's rows of weight above 0; deviations of 0 become 1.

    A row counts as often as its column ``times`` says, once without one.

    Deviations are taken about the mean of all rows seen so far in a task, and joined by the parallel formula, so large means do no harm.
    """
    def scan(batches: Iterator) -> Iterator:
        n, ones, mean, off = np.zeros(models), np.zeros(models), np.zeros((models, size)), np.zeros((models, size))
        for batch in batches:
            x, y = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size), batch.column("y").to_numpy(zero_copy_only=False)
            repeats = batch.column(times).to_numpy().astype(float) if times else np.ones(batch.num_rows)
            for k, inside in enumerate(weigh(batch) > 0):
                if repeats[inside].any():
                    some, often = x[inside], repeats[inside]
                    middle = often @ some / often.sum()
                    n[k], mean[k], off[k] = _joined(n[k], mean[k], off[k], often.sum(), middle, often @ (some - middle) ** 2)
                    ones[k] += often[y[inside] != 0].sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(models), pa.int32()), pa.array(n), pa.array(ones),
                                          *(pa.array([r.tobytes() for r in t], pa.binary()) for t in (mean, off))], ["model", "n", "ones", "mean", "off"])

    def added(group: pa.Table) -> pa.Table:
        n, mean, off = 0.0, np.zeros(size), np.zeros(size)
        for r in group.to_pylist():
            n, mean, off = _joined(n, mean, off, r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["off"]))
        ones = sum(r["ones"] for r in group.to_pylist())
        return pa.table([group.column("model")[:1], pa.array([n]), pa.array([ones]), pa.array([mean.tobytes()], pa.binary()), pa.array([off.tobytes()], pa.binary())], names=group.schema.names)

    schema = "model int, n double, ones double, mean binary, off binary"
    counts, means, deviations = np.zeros((models, 2)), np.zeros((models, size)), np.ones((models, size))
    for r in rows.mapInArrow(scan, schema).groupBy("model").applyInArrow(added, schema).collect():
        k, n = r["model"], r["n"]
        counts[k] = n - r["ones"], r["ones"]
        means[k] = np.frombuffer(r["mean"])
        deviations[k] = np.sqrt(np.frombuffer(r["off"]) / max(n, 1))
    deviations[deviations == 0] = 1.0
    return counts, means, deviations


def _joined(n: float, mean: np.ndarray, off: np.ndarray, m: float, other: np.ndarray, other_off: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, mean and squared deviations of two sets of rows together."""
    if not n + m:
        return n, mean, off
    apart = other - mean
    return n + m, mean + apart * (m / (n + m)), off + other_off + apart ** 2 * (n * m / (n + m))


def predicted(rows: DataFrame, size: int, tables: Sequence[np.ndarray], keep: Sequence[str], wanted: Callable[[pa.RecordBatch], np.ndarray],
              fits: Sequence[Fit] | None = None) -> DataFrame:
    """``keep`` columns, ``model int``, ``scores array<double>`` (probability of each class) and ``predicted int`` for the rows that ``wanted`` marks for a model.

    Of equal probabilities the first class is predicted; of two classes the second needs more than one half.
    """
    lines = tables[0].shape[0]
    raw = np.stack([np.array(t, float) for t in tables])
    for i, f in enumerate(fits or ()):
        raw[i, :, :size] /= 1.0 if f.deviation is None else f.deviation
        raw[i, :, size] -= raw[i, :, :size] @ (np.zeros(size) if f.mean is None else f.mean)
    block = _rows_at_once(size)
    shared = rows.sparkSession.sparkContext.broadcast(raw)  # models * classes * features numbers

    def run(batches: Iterator) -> Iterator:
        for batch in (b.slice(at, block) for b in batches for at in range(0, b.num_rows, block)):
            z, _ = _answers(batch, size, shared.value)
            if lines == 1:
                one = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                scores = np.concatenate([1 - one, one], 1)
            else:
                scores = np.exp(z - z.max(1, keepdims=True)) if batch.num_rows else z
                scores = scores / scores.sum(1, keepdims=True)
            model, row = np.nonzero(wanted(batch))
            told = scores[model, :, row]
            lists = pa.ListArray.from_arrays(np.arange(0, told.size + 1, told.shape[1], dtype=np.int32), pa.array(told.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in keep), pa.array(model, pa.int32()), lists,
                                              pa.array(told.argmax(1) if len(told) else [], pa.int32())], [*keep, "model", "scores", "predicted"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "model int, scores array<double>, predicted int"]))
