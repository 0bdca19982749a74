"""Decision trees over 0/1 features, many grown together: one scan a level, however many trees there are.

Splits are those of MLlib's classifier: greedy by Gini gain, of equal gains the first place, at least ``least`` rows a side, leaves of one prediction merged.
Rows hold ``y`` (the class number), ``fold`` and ``places``, those features that are 1; a scan costs the places that are set, not all features. A tree
cut at a depth is the tree grown to that depth, so one tree serves all depths of a search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .logistic_fits import Lists

_CELLS = 1 << 23  # counts that a task holds at once; with more, the open nodes of a level take several scans
_SLICE = 1024  # places that are compared in one group
_BLOCK = 1 << 23  # cells of the 0/1 table that are spread out at once
_SPLIT = "node int, gain double, place int, total binary, shown binary"


@dataclass
class Tree:
    """Nodes in the order of their making: the place asked (-1: a leaf), the nodes without and with it, depth, and rows by class."""

    place: list = field(default_factory=list)
    without: list = field(default_factory=list)
    having: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    counts: list = field(default_factory=list)

    def add(self, depth: int, counts: np.ndarray | None) -> int:
        for column, value in zip((self.place, self.without, self.having, self.depth, self.counts), (-1, 0, 0, depth, counts)):
            column.append(value)
        return len(self.place) - 1

    def table(self) -> np.ndarray:
        return np.array([self.place, self.without, self.having])

    def cut(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and children of each node of the tree of at most ``depth``, and each node's share of the classes; leaves below a node that say the same are merged."""
        table, counts = self.table(), np.array(self.counts, float)
        table[0, np.array(self.depth) >= depth] = -1
        says = counts.argmax(1)
        for i in range(len(counts) - 1, -1, -1):  # children come after their parents
            place, a, b = table[:, i]
            if place >= 0 and table[0, a] < 0 and table[0, b] < 0 and says[a] == says[b]:
                table[0, i] = -1
        return table, counts / np.maximum(counts.sum(1, keepdims=True), 1)


def _blocks(batches: Iterator, size: int) -> Iterator[tuple[pa.RecordBatch, Lists, np.ndarray]]:
    """Pieces of batches with their places, flat and as a 0/1 table."""
    rows = max(1, min(4096, _BLOCK // max(size, 1)))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            places = Lists(some.column("places"))
            shown = np.zeros((some.num_rows, size + 1), bool)
            shown[places.row, places.values] = True
            yield some, places, shown


def _routed(table: np.ndarray, shown: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at, rows = np.zeros(len(shown), np.int64), np.arange(len(shown))
    while (table[0, at] >= 0).any():
        place = table[0, at]
        at = np.where(place < 0, at, np.where(shown[rows, place], table[2, at], table[1, at]))
    return at


def _gini(counts: np.ndarray) -> np.ndarray:
    return 1 - ((counts / np.maximum(counts.sum(-1, keepdims=True), 1)) ** 2).sum(-1)


def _splits(rows: DataFrame, size: int, classes: int, trees: Sequence[Tree], folds: np.ndarray, leasts: np.ndarray, nodes: Sequence[tuple[int, int]]) -> dict[int, tuple]:
    """By the place in ``nodes`` (tree, node): the best split's gain and place (gain 0: none), and rows by class, of the node and of its side with the place."""
    tables, width = [t.table() for t in trees], size + 1
    numbers = [np.full(len(t.place), -1) for t in trees]
    for i, (t, node) in enumerate(nodes):
        numbers[t][node] = i
    asked = sorted({t for t, _ in nodes})
    least = [int(leasts[t]) for t, _ in nodes]

    def scan(batches: Iterator) -> Iterator:
        counts = np.zeros(len(nodes) * classes * width, np.int64)
        for some, places, shown in _blocks(batches, size):
            y, fold = (some.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            for t in asked:
                number = np.where(fold != folds[t], numbers[t][_routed(tables[t], shown)], -1)
                group = np.where(number < 0, -1, number * classes + y)
                inside = group[places.row]
                keys = np.concatenate([inside[inside >= 0] * width + places.values[inside >= 0], group[group >= 0] * width + size])
                low = int(keys.min(initial=0))
                added = np.bincount(keys - low)
                counts[low:low + len(added)] += added
        cells = counts.reshape(len(nodes), classes, width)
        for i in np.flatnonzero(cells[:, :, size].sum(1)):
            cuts = range(0, size, _SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(cuts), pa.int32()), pa.array(list(cuts), pa.int32()), pa.array([cells[i, :, size].tobytes()] * len(cuts), pa.binary()),
                                              pa.array([cells[i, :, a:min(a + _SLICE, size)].tobytes() for a in cuts], pa.binary())], ["node", "start", "total", "shown"])

    def best(group: pa.Table) -> pa.Table:
        node, start = group.column("node")[0].as_py(), group.column("start")[0].as_py()
        total, shown = (sum(np.frombuffer(x.as_py(), np.int64) for x in group.column(c)) for c in ("total", "shown"))
        having = shown.reshape(classes, -1).T
        without = total - having
        n, a, b = total.sum(), without.sum(1), having.sum(1)
        gain = _gini(total) - a / n * _gini(without) - b / n * _gini(having)
        gain[(a < least[node]) | (b < least[node])] = 0
        k = int(gain.argmax())
        return pa.table([pa.array([node], pa.int32()), pa.array([float(gain[k])]), pa.array([start + k], pa.int32()), pa.array([total.tobytes()], pa.binary()),
                         pa.array([having[k].tobytes()], pa.binary())], names=["node", "gain", "place", "total", "shown"])

    found: dict[int, tuple] = {}
    told = rows.select("y", "fold", "places").mapInArrow(scan, "node int, start int, total binary, shown binary").groupBy("node", "start").applyInArrow(best, _SPLIT)
    for r in sorted(told.collect(), key=lambda r: (r["node"], r["place"])):
        if r["node"] not in found or r["gain"] > found[r["node"]][0]:
            found[r["node"]] = r["gain"], r["place"], np.frombuffer(r["total"], np.int64), np.frombuffer(r["shown"], np.int64)
    return found


def grow(rows: DataFrame, size: int, classes: int, settings: Sequence[tuple[int, int]], depth: int) -> list[Tree]:
    """A tree of at most ``depth`` for each of ``settings``: the fold that is left out (-1: none) and the least rows a side. Write ``rows`` out first, they are read once a level."""
    trees = [Tree() for _ in settings]
    folds, leasts = (np.array([s[k] for s in settings]) for k in (0, 1))
    nodes = [(t, tree.add(0, np.zeros(classes, np.int64))) for t, tree in enumerate(trees)] if depth > 0 and size else []
    for tree in trees if not nodes else ():
        tree.add(0, np.ones(classes, np.int64))
    at_once = max(1, _CELLS // (classes * (size + 1)))
    while nodes:
        coming = []
        for a in range(0, len(nodes), at_once):
            some = nodes[a:a + at_once]
            for i, (gain, place, total, having) in sorted(_splits(rows, size, classes, trees, folds, leasts, some).items()):
                t, node = some[i]
                tree = trees[t]
                tree.counts[node] = total
                if gain <= 0:
                    continue
                tree.place[node] = place
                tree.without[node], tree.having[node] = (tree.add(tree.depth[node] + 1, side) for side in (total - having, having))
                coming += [(t, new) for new in (tree.without[node], tree.having[node])
                           if tree.depth[new] < depth and (tree.counts[new] > 0).sum() > 1 and tree.counts[new].sum() >= 2 * leasts[t]]
        nodes = coming
    return trees


def predicted(rows: DataFrame, size: int, cuts: Sequence[tuple], keep: Sequence[str], wanted: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """As ``logistic_fits.predicted``: ``keep``, ``model``, ``scores`` and ``predicted`` of the rows that ``wanted`` marks for each of the cut trees."""
    shared = rows.sparkSession.sparkContext.broadcast(list(cuts))

    def run(batches: Iterator) -> Iterator:
        for some, _, shown in _blocks(batches, size):
            for k, (inside, (table, shares)) in enumerate(zip(wanted(some), shared.value)):
                row = np.flatnonzero(inside)
                told = shares[_routed(table, shown[row])]
                lists = pa.ListArray.from_arrays(np.arange(0, told.size + 1, told.shape[1], dtype=np.int32), pa.array(told.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(row)) for c in keep), pa.array([k] * len(row), pa.int32()), lists,
                                                  pa.array(told.argmax(1), pa.int32())], [*keep, "model", "scores", "predicted"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "model int, scores array<double>, predicted int"]))
