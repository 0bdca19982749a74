"""Scaling, linear risk model, isolation forest and model selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sigmoid
from ..schemas import ALERT_THRESHOLD
from ..session import durable
from . import presence_trees
from .logistic_fits import Fit, fit_many, predicted
from .ordering import row_numbered
from .quality import multiclass_metrics, roc_auc
from .vectors import align_to_model, assemble

# Fixed values of the anomaly model.
TREES = 100
TREE_ROWS = 256
CONTAMINATION = 0.05
EULER_GAMMA = 0.5772156649015329


@dataclass(frozen=True)
class Scaler:
    """Population mean and deviation per feature; constant features are divided by 1."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    deviation: tuple[float, ...]

    def columns(self) -> list[Column]:
        return [(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(d)
                for f, m, d in zip(self.features, self.mean, self.deviation)]

    def transform(self, df: DataFrame) -> DataFrame:
        aligned = df.withColumns({f: F.lit(0.0) for f in self.features if f not in df.columns})
        return aligned.withColumns(dict(zip(self.features, self.columns())))


def fit_scaler(train: DataFrame, features: Sequence[str]) -> Scaler:
    """Fit on training rows; one row of statistics comes to the driver."""
    values = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    row = train.agg(*(F.avg(c).alias(f"m_{f}") for f, c in values.items()),
                    *(F.stddev_pop(c).alias(f"d_{f}") for f, c in values.items())).first()
    return Scaler(tuple(features), tuple(row[f"m_{f}"] for f in features),
                  tuple(row[f"d_{f}"] or 1.0 for f in features))


@dataclass(frozen=True)
class LinearModel:
    """Scaled logistic model whose score is a plain SQL expression."""

    scaler: Scaler
    coefficients: tuple[float, ...]
    intercept: float

    def contributions(self) -> list[Column]:
        return [F.lit(c) * x for c, x in zip(self.coefficients, self.scaler.columns())]

    def probability(self) -> Column:
        return sigmoid(reduce(Column.__add__, self.contributions(), F.lit(self.intercept)))


def class_weights(train: DataFrame, n: int, positives: int, label: str = "label") -> DataFrame:
    """Add ``weight = n / (2 * n_class)`` so both classes weigh the same."""
    return train.withColumn("weight", F.when(F.col(label) == 1, n / (2.0 * max(positives, 1)))
                            .otherwise(n / (2.0 * max(n - positives, 1))))


def train_logistic(train: DataFrame, features: Sequence[str], c: float = 1.0, max_iter: int = 2000) -> LinearModel:
    """Balanced, L2-regularised logistic regression on scaled features; the fit is distributed."""
    scaler = fit_scaler(train, features)
    n, positives = train.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1)).first()
    weighted = class_weights(scaler.transform(train.select("label", *features)), n, positives)
    rows = assemble(weighted, features).select("features", F.col("label").cast("double").alias("label"), "weight")
    fitted = LogisticRegression(weightCol="weight", regParam=1.0 / (c * n), standardization=False,
                                maxIter=max_iter).fit(rows)  # the weights add up to n
    return LinearModel(scaler, tuple(float(v) for v in fitted.coefficients), float(fitted.intercept))


def risk_score(df: DataFrame, model: LinearModel, threshold: float = ALERT_THRESHOLD,
               anomaly: IsolationForest | None = None) -> DataFrame:
    """Probability, anomaly score, alert flag and mode; nothing is ever acted on."""
    missing = {f: F.lit(0.0) for f in model.scaler.features if f not in df.columns}
    scored = df.withColumns(missing).withColumn("risk_score", model.probability()).drop(*missing)
    if anomaly is not None:
        scored = anomaly_score(scored, anomaly)
    return scored.withColumns({"would_alert": F.col("risk_score") >= threshold, "mode": F.lit("dry_run")})


# ---- isolation forest --------------------------------------------------------------------------

@dataclass(frozen=True)
class IsolationForest:
    """Trees as flat node arrays (at most 2 * 256 - 1 nodes each), the scaler and the alert offset."""

    scaler: Scaler
    trees: tuple[dict[str, np.ndarray], ...]
    rows: int
    offset: float


def _average_path(n: np.ndarray) -> np.ndarray:
    """Expected depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + EULER_GAMMA
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1)))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth value) of one random tree over at most 256 rows."""
    nodes: list[tuple] = []
    pending = [(np.arange(len(x)), 0, -1, 0)]
    while pending:
        rows, depth, parent, side = pending.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = at
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + float(_average_path(len(rows)))])
            continue
        feature = int(rng.choice(usable))
        cut = rng.uniform(low[feature], high[feature])
        goes_left = x[rows, feature] <= cut
        nodes.append([feature, float(cut), -1, -1, 0.0])
        pending.append((rows[goes_left], depth + 1, at, 0))
        pending.append((rows[~goes_left], depth + 1, at, 1))
    return nodes


def tree_samples(train: DataFrame, key: str, seed: int, trees: int, rows: int) -> DataFrame:
    """About ``rows`` rows per tree, drawn by hash order; a row can serve several trees.

    A hash threshold keeps slightly more rows than needed, so the per-tree ranking sees a bounded
    number of rows however large the training data is.
    """
    n = max(train.count(), 1)
    share = min(1.0, (rows + 10 * rows ** 0.5) / n)
    limit = int(share * (1 << 52))

    def draw(tree: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), tree, F.col(key)), 12)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < limit)
    spread = train.withColumn("tree", F.explode(chosen)).withColumn("_draw", draw(F.col("tree")))
    order = Window.partitionBy("tree").orderBy("_draw", key)
    return spread.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= rows).drop("_rn")


def train_isolation_forest(benign: DataFrame, features: Sequence[str], key: str, seed: int = 42, trees: int = TREES,
                           rows: int = TREE_ROWS, contamination: float = CONTAMINATION) -> IsolationForest:
    """Random trees on small hash-drawn samples of benign rows, one task group per tree."""
    benign = durable(benign.select(key, *features))  # read four times below
    scaler = fit_scaler(benign, features)
    scaled = scaler.transform(benign)
    limit = int(np.ceil(np.log2(max(rows, 2))))
    names = list(features)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["_draw", key])
        tree = int(ordered["tree"].iloc[0])
        nodes = _grow(ordered[names].to_numpy(float), np.random.default_rng((seed, tree)), limit)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])
        return out.assign(tree=tree, node=range(len(out)), rows=len(ordered))

    schema = "feature int, cut double, left int, right int, depth double, tree int, node int, rows int"
    grown = tree_samples(scaled, key, seed, trees, rows).groupBy("tree").applyInPandas(build, schema)
    table = grown.toPandas().sort_values(["tree", "node"])  # at most trees * (2 * rows - 1) nodes
    flat = tuple({c: t[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth")}
                 for _, t in table.groupby("tree"))
    forest = IsolationForest(scaler, flat, int(table["rows"].max()), 0.0)
    return IsolationForest(scaler, flat, forest.rows, quantile(anomaly_score(benign, forest), "anomaly_score", 1 - contamination))


def quantile(df: DataFrame, column: str, share: float) -> float:
    """The exact quantile, between neighbours in proportion: the values are numbered in order, and the two about the place come to the driver."""
    ranked = durable(row_numbered(df.select(column).filter(F.col(column).isNotNull()), (), (column,), "_rn").select(column, "_rn"))
    n = ranked.count()
    place = (n - 1) * share
    low = int(place)
    near = {r["_rn"]: r[column] for r in ranked.filter(F.col("_rn").between(low + 1, low + 2)).collect()}
    return float(near[low + 1] + (near.get(low + 2, near[low + 1]) - near[low + 1]) * (place - low))


def anomaly_score(df: DataFrame, forest: IsolationForest, name: str = "anomaly_score") -> DataFrame:
    """Isolation score minus the offset: above 0 is stranger than the accepted share of training rows."""
    shared = df.sparkSession.sparkContext.broadcast(forest.trees)  # bounded: trees * (2 * rows - 1) nodes
    scale = float(_average_path(forest.rows)) or 1.0
    offset = forest.offset

    @F.pandas_udf("double")
    def isolation(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=float)
        values = np.vstack(x.to_numpy())
        lanes = np.arange(len(values))
        total = np.zeros(len(values))
        for tree in shared.value:
            at = np.zeros(len(values), dtype=int)
            while True:
                feature = tree["feature"][at]
                inner = feature >= 0
                if not inner.any():
                    break
                left = values[lanes, np.maximum(feature, 0)] <= tree["cut"][at]
                at = np.where(inner, np.where(left, tree["left"][at], tree["right"][at]), at)
            total += tree["depth"][at]
        return pd.Series(np.power(2.0, -total / len(shared.value) / scale) - offset)

    missing = {f: F.lit(0.0) for f in forest.scaler.features if f not in df.columns}
    return df.withColumns(missing).withColumn(name, isolation(F.array(*forest.scaler.columns()))).drop(*missing)


# ---- behaviour-matrix models -------------------------------------------------------------------

STRENGTHS = (0.01, 0.1, 1.0, 10.0)  # fixed values: inverse penalties of the search

def _all_rows(models: int):
    return lambda batch: np.ones((models, batch.num_rows))


def eliminate(rows: DataFrame, size: int, keeps: Sequence[int], classes: int = 2, step: float = 0.1, c: float = 1.0) -> dict[int, list[int]]:
    """Recursive elimination on ``rows(y, x or places)``: refit, drop the weakest squared coefficients, until few enough remain.

    Each round drops ``step`` of the original number of features, those of least weight and of equals the first. A round is a mask over the one table and starts at
    the last round's coefficients; no row is copied or narrowed. All wanted sizes share one path: a size is reached by a
    smaller last drop from the round before it. Gives the places kept by size. Write ``rows`` out first, they are read once a step of each fit.
    """
    n = max(rows.count(), 1)
    left, start = np.arange(size), None
    per_round = max(1, int(size * step))
    found = {k: left.tolist() for k in keeps if k >= size}
    open_sizes = sorted((k for k in keeps if k < size), reverse=True)
    while open_sizes:
        used = np.zeros(size, bool)
        used[left] = True
        start = fit_many(rows, size, [Fit(1.0 / (c * n), used, start=start)], _all_rows(1), classes, tolerance=1e-5)[0]
        weakest = np.argsort(np.square(start[:, left]).sum(axis=0), kind="stable")
        while open_sizes and len(left) - open_sizes[0] <= per_round:
            k = open_sizes.pop(0)
            found[k] = np.delete(left, weakest[:len(left) - k]).tolist()
        left = np.delete(left, weakest[:per_round])
    return found


def _dense(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``y`` and the features as ``x``, null as 0."""
    return durable(rows.select(F.col("label").cast("double").alias("y"), F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)).alias("x")))


def rfe_path(train: DataFrame, features: Sequence[str], keeps: Sequence[int], step: float = 0.1) -> dict[int, list[str]]:
    """``eliminate`` over columns: the features kept by size."""
    return {k: [features[i] for i in kept] for k, kept in eliminate(_dense(train, features), len(features), keeps, step=step).items()}


def rfe(train: DataFrame, features: Sequence[str], keep: int, step: float = 0.1) -> list[str]:
    """The ``keep`` features that survive recursive elimination."""
    return rfe_path(train, features, [keep], step)[keep]


def rfe_sweep(train: DataFrame, test: DataFrame, features: Sequence[str], percentages: Sequence[int] = (3, 4, 5, 10, 20, 50, 70, 90)) -> DataFrame:
    """``sweep`` over columns."""
    return sweep(_dense(train, features), _dense(test, features), len(features), percentages)


def sweep(train: DataFrame, test: DataFrame, size: int, percentages: Sequence[int] = (3, 4, 5, 10, 20, 50, 70, 90), classes: int = 2, c: float = 1.0) -> DataFrame:
    """Balanced accuracy on the test rows by percentage of features kept; both frames have ``y`` and ``x`` or ``places``.

    All percentages are refitted together, with the penalty of the elimination.
    """
    sizes = {p: max(1, int(p / 100 * size)) for p in percentages}
    kept = eliminate(train, size, sorted(set(sizes.values())), classes, c=c)
    n = max(train.count(), 1)
    used = [np.isin(np.arange(size), kept[count]) for count in sizes.values()]
    tables = fit_many(train, size, [Fit(1.0 / (c * n), u) for u in used], _all_rows(len(used)), classes)
    told = durable(predicted(test, size, tables, ["y"], lambda batch: np.ones((len(used), batch.num_rows), bool)))
    parts = []
    for i, (percent, count) in enumerate(sizes.items()):
        figure = multiclass_metrics(told.filter(F.col("model") == i), "y", "predicted", digits=6)
        parts.append(figure.select(F.lit(percent).alias("percent"), F.lit(count).alias("features"), "balanced_accuracy"))
    return reduce(DataFrame.unionByName, parts)


def _figure_by_model(told: DataFrame, classes: int) -> dict[int, float | None]:
    """By model, in one job: the area under the ROC curve for two classes, weighted F1 (9 digits) for more; the driver gets models times classes squared counts."""
    if classes == 2:
        areas = roc_auc(told.withColumn("score", F.col("scores")[1]), "score", "y", ("model",))
        return {r["model"]: r["roc_auc"] for r in areas.collect()}
    cells: dict[int, np.ndarray] = {}
    for r in told.groupBy("model", "y", "predicted").agg(F.count(F.lit(1)).alias("n")).collect():
        cells.setdefault(r["model"], np.zeros((classes, classes)))[int(r["y"]), r["predicted"]] = r["n"]
    return {k: round(float((2 * np.diag(c) / np.maximum(c.sum(0) + c.sum(1), 1) * c.sum(1)).sum() / c.sum()), 9) for k, c in cells.items()}


def tree_search(rows: DataFrame, size: int, classes: int, folds: int = 3) -> tuple[int, int, tuple]:
    """The best depth and least rows a side of the whole grid by the folds, and the tree refitted with them, cut; ``rows`` has ``y``, ``fold`` and ``places``.

    Trees of all folds and sides grow together to the largest depth, and are cut for the others. Figures as in ``logistic_search``; of equal ones the first setting is taken.
    """
    sides = sorted({s // 2 for s in SPLITS})
    settings = [(f, m) for m in sides for f in range(folds)]
    grown = dict(zip(settings, presence_trees.grow(rows, size, classes, settings, max(DEPTHS))))
    models = [(d, m, f) for d in DEPTHS for m in sides for f in range(folds)]
    of = np.array([f for _, _, f in models])
    told = presence_trees.predicted(rows, size, [grown[f, m].cut(d) for d, m, f in models], ["y"], lambda b: b.column("fold").to_numpy()[None, :] == of[:, None])
    figures = _figure_by_model(told, classes)
    mean = {}
    for i, (d, m, _) in enumerate(models):
        mean.setdefault((d, m), []).append(figures.get(i))
    mean = {k: float(np.mean([x for x in v if x is not None] or [-1.0])) for k, v in mean.items()}
    depth, side = max(mean, key=mean.get)
    return depth, side, presence_trees.grow(rows, size, classes, [(-1, side)], depth)[0].cut(depth)


def logistic_search(rows: DataFrame, size: int, classes: int, folds: int = 3, strengths: Sequence[float] = STRENGTHS) -> tuple[float, np.ndarray, DataFrame]:
    """The best strength, the model refitted with it, and ``strength, figure`` of all; ``rows`` has ``y``, ``x`` or ``places``, and ``fold`` from 0.

    Every fold and strength is a model of one fit, scored on its own fold: by the area under the ROC curve for two classes, by weighted F1 for more.
    The figure is the mean over the folds that have one; of equal figures the first strength is taken.
    """
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = max(sum(sizes.values()), 1)
    pairs = [(c, f) for c in strengths for f in range(folds)]
    of = np.array([f for _, f in pairs])
    tables = fit_many(rows, size, [Fit(1.0 / (c * max(n - sizes.get(f, 0), 1))) for c, f in pairs],
                      lambda b: (b.column("fold").to_numpy()[None, :] != of[:, None]).astype(float), classes, tolerance=1e-5)
    told = durable(predicted(rows, size, tables, ["y"], lambda b: b.column("fold").to_numpy()[None, :] == of[:, None]))
    figures = _figure_by_model(told, classes)
    by = {c: [figures[i] for i, (d, _) in enumerate(pairs) if d == c and figures.get(i) is not None] for c in strengths}
    mean = {c: sum(v) / len(v) if v else None for c, v in by.items()}
    best = max(strengths, key=lambda c: (mean[c] is not None, mean[c] or 0.0, -list(strengths).index(c)))
    table = fit_many(rows, size, [Fit(1.0 / (best * n))], _all_rows(1), classes, tolerance=1e-6)[0]
    return best, table, rows.sparkSession.createDataFrame(list(mean.items()), "strength double, figure double")


# The search grids. A tree without depth limit gets the deepest one there is; a split of s rows leaves s // 2 a side.
DEPTHS = (30, 10, 20)
SPLITS = (2, 5, 10)
ENSEMBLE_SIZES = (50, 100, 200)
LEAVES = (15, 31)
ROUNDS = (50, 100)
RATE = 0.01


def estimators(classes: int, rows: int) -> dict[str, tuple[object, list]]:
    """Classifier and whole parameter grid per name for a fit on ``rows`` rows; extra trees become a forest on the whole sample."""
    def grid(estimator, **values):
        build = ParamGridBuilder()
        for name, options in values.items():
            build = build.addGrid(estimator.getParam(name), list(options))
        return estimator, build.build()
    sides = sorted({s // 2 for s in SPLITS})
    boosted = GBTClassifier(seed=42, stepSize=RATE)
    forest = {"numTrees": ENSEMBLE_SIZES, "maxDepth": DEPTHS, "minInstancesPerNode": sides[:2]}
    zoo = {
        "Decision Tree": grid(DecisionTreeClassifier(seed=42), maxDepth=DEPTHS, minInstancesPerNode=sides),
        "Logistic Regression": grid(LogisticRegression(maxIter=1000, standardization=False), regParam=[1.0 / (c * max(rows, 1)) for c in STRENGTHS]),
        "Random Forest": grid(RandomForestClassifier(seed=42), **forest),
        "Extra Trees": grid(RandomForestClassifier(seed=42, subsamplingRate=1.0, bootstrap=False, featureSubsetStrategy="sqrt"), **forest),
        "Gradient Boosting": grid(boosted, maxDepth=[int(np.ceil(np.log2(n))) for n in LEAVES], maxIter=ROUNDS),
    }
    if classes > 2:
        one_vs_rest = [{OneVsRest.classifier: boosted.copy(g)} for g in zoo["Gradient Boosting"][1]]
        zoo["Gradient Boosting"] = OneVsRest(classifier=boosted), one_vs_rest
    return zoo


def grid_search(train: DataFrame, estimator, grid, classes: int, folds: int = 3, parallelism: int = 4):
    """Cross-validated search: ROC-AUC for two classes, weighted F1 for more."""
    evaluator = (BinaryClassificationEvaluator(metricName="areaUnderROC") if classes == 2
                 else MulticlassClassificationEvaluator(metricName="f1"))
    return CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds,
                          parallelism=parallelism, seed=42).fit(train)


def model_zoo(train: DataFrame, test: DataFrame, classes: int, names: Sequence[str] | None = None, grids: dict | None = None) -> DataFrame:
    """Test predictions of the best model per classifier: model, label, predicted, scores of the classes.

    Both frames have ``features, label``. ``grids`` may replace a classifier's grid by lists of parameter values.
    """
    rows, parts = train.count(), []
    for name, (estimator, grid) in estimators(classes, rows).items():
        if names and name not in names:
            continue
        if grids and name in grids:
            build = ParamGridBuilder()
            for param, options in grids[name].items():
                build = build.addGrid(estimator.getParam(param), options)
            grid = build.build()
        best = grid_search(train, estimator, grid, classes).bestModel
        predicted = best.transform(test)
        scores = vector_to_array("probability") if "probability" in predicted.columns else F.lit(None).cast("array<double>")
        parts.append(predicted.select(F.lit(name).alias("model"), F.col("label").cast("int").alias("label"),
                                      F.col("prediction").cast("int").alias("predicted"), scores.alias("scores")))
    return reduce(DataFrame.unionByName, parts)
