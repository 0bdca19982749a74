import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from palisade.operators import models as M
from palisade.operators import presence_trees as P
from palisade.session import durable


@pytest.fixture(scope="module")
def drawn(spark):
    draw = np.random.default_rng(3)
    x = draw.random((400, 30)) < draw.uniform(0.1, 0.6, 30)
    y = (x[:, 3].astype(int) + 2 * (x[:, 7] & x[:, 11]) + (draw.random(400) < 0.15)) % 3
    rows = [(int(b), i % 3, np.flatnonzero(a).tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return durable(spark.createDataFrame(rows, "y int, fold int, places array<int>").repartition(3)), x, y


@pytest.mark.parametrize("least", [1, 5])
def test_trees_are_those_of_mllib(spark, drawn, monkeypatch, least):
    """Also with few places in a group and few nodes in a scan, and cut at a lower depth."""
    monkeypatch.setattr(P, "_SLICE", 8)
    monkeypatch.setattr(P, "_CELLS", 500)
    rows, x, y = drawn
    both = P.grow(rows, 30, 3, [(-1, least), (1, least)], 12)
    for tree, out in zip(both, (-1, 1)):
        train = spark.createDataFrame([(float(b), Vectors.dense(a.astype(float))) for i, (a, b) in enumerate(zip(x, y)) if i % 3 != out], ["label", "features"])
        for depth in (12, 3):
            model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, seed=42).fit(train)
            table, shares = tree.cut(depth)
            want = np.array([model.predictProbability(Vectors.dense(a.astype(float))).toArray() for a in x[:120]])
            shown = np.concatenate([x[:120], np.zeros((120, 1), bool)], 1)
            assert np.allclose(shares[P._routed(table, shown)], want)


def test_whole_grid_in_one_growth(spark, drawn, monkeypatch):
    """The search scans once a level of all trees; its tree predicts the rows it was asked for."""
    scans, splits = [], P._splits
    monkeypatch.setattr(P, "_splits", lambda *a: scans.append(1) or splits(*a))
    rows, x, y = drawn
    depth, side, cut = M.tree_search(rows, 30, 3)
    assert depth in M.DEPTHS and side in (1, 2, 5) and len(scans) <= 2 * max(M.DEPTHS)
    told = P.predicted(rows, 30, [cut], ["y"], lambda b: np.ones((1, b.num_rows), bool)).agg(F.avg((F.col("y") == F.col("predicted")).cast("int")), F.count(F.lit(1))).first()
    assert told[0] > 0.8 and told[1] == 400
