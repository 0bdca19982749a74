"""The behaviour-matrix model job: long (sample, name) rows, selected features, sparse vectors, elimination, searched models, figures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, functions as F

from ..operators import models as M
from ..operators import presence_trees
from ..operators import quality as Q
from ..operators import selection as L
from ..operators import splits as S
from ..operators.logistic_fits import predicted
from ..session import durable


#: Fixed value: the least mutual information, in nats, of a name that goes into the models.
LEAST_INFORMATION = 0.01
_PLACES = 1 << 16, 1 << 20  # that a task of a fit reads, at least and at most


@dataclass(frozen=True)
class Matrix:
    """``rows(sample_id, y, split, fold, places)``: for each sample the places in ``names`` of those it shows; labels are numbered from 0 by frequency in ``classes``.

    ``fold`` deals the training samples of each class in turn, null for the others.
    """

    rows: DataFrame
    names: tuple[str, ...]
    classes: tuple

    def part(self, split: str) -> DataFrame:
        return self.rows.filter(F.col("split") == split)


def matrix(presence: DataFrame, labels: DataFrame, splits: DataFrame, label: str = "label", least: float = LEAST_INFORMATION) -> Matrix:
    """All samples over all names whose mutual information on the training samples is ``least`` or more.

    The chosen names reach the driver, as a model over them must; a sample is one row with the places of its names. No wide columns are made.
    """
    known = labels.select("sample_id", F.col(label).alias("label")).filter(F.col("label").isNotNull()).join(splits.select("sample_id", "split"), "sample_id")
    known = durable(known)
    presence = durable(L.restrict(presence, known))  # names are made once, of the labelled samples only
    train = known.filter("split = 'train'")
    scores = L.mutual_information(presence, train)
    names = sorted(r[0] for r in scores.filter(F.col("mi") >= least).select(L.FEATURE).collect())
    classes = [r[0] for r in train.groupBy("label").count().orderBy(F.desc("count"), "label").collect()]
    spark = presence.sparkSession
    numbered = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{L.FEATURE} string, place int")
    shown = presence.join(numbered, L.FEATURE).groupBy("sample_id").agg(F.sort_array(F.collect_set("place")).alias("places"))
    number = spark.createDataFrame([(c, i) for i, c in enumerate(classes)], f"label {train.schema['label'].dataType.simpleString()}, y int")
    rows = (known.join(number, "label").join(shown, "sample_id", "left")
            .select("sample_id", "y", "split", F.coalesce("places", F.array().cast("array<int>")).alias("places")))
    rows = durable(rows)
    folds = S.stratified_folds(rows.filter("split = 'train'").select("sample_id", "y"), "sample_id", "y").select("sample_id", "fold")
    shown_in_all = rows.agg(F.sum(F.size("places"))).first()[0] or 0
    pieces = max(1, -(-shown_in_all // min(max(_PLACES[0], 64 * len(names)), _PLACES[1])))  # a task of a fit returns sums as long as the names, so it should read more than that
    return Matrix(durable(rows.join(folds, "sample_id", "left").repartition(pieces)), tuple(names), tuple(classes))


def eliminated(data: Matrix, keep: int) -> list[str]:
    """The ``keep`` names that survive recursive elimination on the training samples."""
    return [data.names[i] for i in M.eliminate(data.part("train"), len(data.names), [keep], len(data.classes))[keep]]


def narrowed(data: Matrix, keep: Sequence[str]) -> Matrix:
    """The matrix over the kept names only, in their order."""
    place = {n: i for i, n in enumerate(data.names)}
    new = F.create_map(*(F.lit(x) for i, n in enumerate(keep) for x in (place[n], i)))
    places = F.sort_array(F.filter(F.transform("places", lambda p: F.try_element_at(new, p)), lambda p: p.isNotNull()))
    return Matrix(data.rows.withColumn("places", places), tuple(keep), data.classes)


def logistic(data: Matrix) -> DataFrame:
    """Test predictions of the searched logistic model: model, label, predicted, scores."""
    rows = durable(data.rows)
    _, table, _ = M.logistic_search(rows.filter("split = 'train'"), len(data.names), len(data.classes))
    told = predicted(rows.filter("split = 'test'"), len(data.names), [table], ["y"], lambda b: np.ones((1, b.num_rows), bool))
    return told.select(F.lit("Logistic Regression").alias("model"), F.col("y").alias("label"), "predicted", "scores")


def decision_tree(data: Matrix) -> DataFrame:
    """Test predictions of the searched decision tree: model, label, predicted, scores."""
    rows = durable(data.rows)
    _, _, cut = M.tree_search(rows.filter("split = 'train'"), len(data.names), len(data.classes))
    told = presence_trees.predicted(rows.filter("split = 'test'"), len(data.names), [cut], ["y"], lambda b: np.ones((1, b.num_rows), bool))
    return told.select(F.lit("Decision Tree").alias("model"), F.col("y").alias("label"), "predicted", "scores")


def predictions(data: Matrix, names: Sequence[str] | None = None, grids: dict | None = None) -> DataFrame:
    """Test predictions of the searched models over the matrix; the logistic model's folds and strengths are one fit, the decision tree's settings grow together, ensembles are searched by the tuner."""
    parts = []
    if (names is None or "Decision Tree" in names) and "Decision Tree" not in (grids or ()):
        parts.append(decision_tree(data))
    if names is None or "Logistic Regression" in names:
        parts.append(logistic(data))
    trees = [n for n in M.estimators(len(data.classes), 1) if n != "Logistic Regression" and (n != "Decision Tree" or n in (grids or ())) and (names is None or n in names)]
    if trees:
        size = len(data.names)
        vector = F.udf(lambda places: SparseVector(size, places, [1.0] * len(places)), VectorUDT())  # one small row helper, for the tree models only
        train, test = (data.part(s).select(vector("places").alias("features"), F.col("y").cast("double").alias("label")) for s in ("train", "test"))
        parts.append(M.model_zoo(train, test, len(data.classes), trees, grids))
    return reduce(DataFrame.unionByName, parts)


def figures(predicted: DataFrame, classes: int) -> DataFrame:
    """Per model: rows, accuracy, balanced accuracy, weighted F1 and the ROC-AUC.

    For two classes it is that of class 1; for more the mean of one class against the rest, null if the test samples lack a class.
    """
    quality = predicted.groupBy("model").agg(F.count(F.lit(1)).alias("rows"))
    parts = None
    for model in sorted(r[0] for r in quality.select("model").collect()):
        one = Q.multiclass_metrics(predicted.filter(F.col("model") == model), "label", "predicted").withColumn("model", F.lit(model))
        parts = one if parts is None else parts.unionByName(one)
    wanted = [1] if classes == 2 else list(range(classes))
    by_class = predicted.withColumn("class", F.explode(F.array(*(F.lit(c) for c in wanted)))).select(
        "model", "class", F.get("scores", F.col("class")).alias("score"), (F.col("label") == F.col("class")).cast("int").alias("hit"))
    areas = Q.roc_auc(by_class, "score", "hit", ("model", "class")).groupBy("model").agg(
        F.when(F.count("roc_auc") == len(wanted), F.avg("roc_auc")).alias("roc_auc"))
    return quality.join(parts, "model").join(areas, "model", "left")
