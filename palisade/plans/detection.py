"""End-to-end jobs: train, evaluate, score and publish."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators import quality as Q
from ..operators import serving
from ..operators import splits as S
from ..operators.logistic_fits import Fit, fit_many, moments, predicted
from ..operators.models import (IsolationForest, LinearModel, risk_score, train_isolation_forest, train_logistic)
from ..operators.ordering import row_numbered
from ..schemas import ALERT_THRESHOLD, WINDOW_FEATURES
from ..session import durable
from ..sources.alerts import write_alerts


@dataclass(frozen=True)
class Baseline:
    """Fitted models and the quality report, one row per split."""

    linear: LinearModel
    forest: IsolationForest
    report: DataFrame


def train_baseline(windows: DataFrame, features: Sequence[str] = WINDOW_FEATURES, seed: int = 42,
                   annotations: DataFrame | None = None, allow_proxy: bool = False, key: str = "window_id") -> Baseline:
    """Guarded, source-separated training of both models with a report on validation and test.

    Windows are checkpointed with their split, because several fits and reports read them.
    """
    S.guard_representation(windows, allow_proxy)
    S.guard_labels(windows)
    split = durable(S.assign_split(windows, S.source_split(windows, seed)).select(
        key, "source", "label", "window_start", "split", *features))
    train = split.filter(F.col("split") == "train")
    forest = train_isolation_forest(train.filter(F.col("label") == 0), features, key, seed)
    linear = train_logistic(train, features)
    held = risk_score(split.filter(F.col("split") != "train"), linear, threshold=0.5)
    figures = Q.binary_metrics(held, group=("split",)).join(Q.roc_auc(held, group=("split",)), "split")
    report = S.split_report(split).join(figures, "split", "left")
    if annotations is not None:
        leads = Q.lead_time(held.filter(F.col("split") == "test"), annotations)
        report = report.join(leads.agg(F.lit("test").alias("split"), F.min("lead_seconds").alias("min_lead_seconds"),
                                       F.avg("lead_seconds").alias("mean_lead_seconds")), "split", "left")
    return Baseline(linear, forest, report)


def scenario_holdout(windows: DataFrame, features: Sequence[str] = WINDOW_FEATURES, key: str = "window_id",
                     seed: int = 42) -> DataFrame:
    """Leave each attack scenario out of training and measure on it plus a benign sample.

    The sample is ``splits.holdout_assignment``'s, taken for all scenarios from one numbering of the benign rows. Equal windows are one weighted row of the fits, so
    their scans follow the number of different windows. All models are fitted in one scan a step and scored in one more, however many scenarios there are; the driver gets the scenarios' names and sizes and their coefficients.
    A scenario that leaves a part with one class keeps its name and has no figures.
    """
    spark = windows.sparkSession
    values = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    rows = durable(windows.select(F.col(key).alias("key"), F.col("label").cast("int").alias("y"), "scenario", values.alias("x")).filter("y in (0, 1)"))
    sizes = rows.filter("y = 1 and scenario is not null").groupBy("scenario").agg(F.count(F.lit(1)).alias("n")).orderBy("scenario").collect()
    names, held = [r["scenario"] for r in sizes], np.array([r["n"] for r in sizes])
    if len(names) < 2:
        raise ValueError("Need at least 2 attack scenarios for held-out evaluation.")
    drawn = np.maximum(held, S.MIN_HOLDOUT_BENIGN)
    steps = np.unique(drawn)
    order = S.seeded_order(F.col("key"), seed)
    ranked = row_numbered(rows.filter("y = 0").select("key", order.alias("_order")), [], ["_order", "key"], "place")
    cuts = ranked.filter(F.col("place").isin(steps.tolist())).orderBy("place").collect()
    # how many of the samples' last rows a benign row comes behind
    behind = [F.coalesce(~S.first_in_order("key", seed, (c["_order"], c["key"])), F.lit(False)).cast("int") for c in cuts]
    numbers = spark.createDataFrame(list(enumerate(names)), "number int, scenario string")
    marked = (rows.join(F.broadcast(numbers), (rows["y"] == 1) & (rows["scenario"] == numbers["scenario"]), "left")
              .select("y", "x", F.coalesce("number", F.lit(-1)).alias("number"), F.when(F.col("y") == 0, sum(behind, F.lit(0))).otherwise(0).alias("level")))
    alike = durable(marked.groupBy("y", "x", "number", "level").agg(F.count(F.lit(1)).alias("n")))  # windows that no model tells apart are one row of that weight
    every, place = np.arange(len(names))[:, None], np.searchsorted(steps, drawn)[:, None]

    def tested(batch) -> np.ndarray:
        y, number, level = (batch.column(c).to_numpy()[None, :] for c in ("y", "number", "level"))
        return np.where(y == 1, number == every, level <= place)

    def times(batch) -> np.ndarray:
        return np.where(tested(batch), 0, batch.column("n").to_numpy())

    counts, means, deviations = moments(alike, len(features), len(names), times, "n")
    whole = counts.sum(1)
    total = alike.filter("y = 0").limit(1).count()
    both = (counts > 0).all(1) & (held > 0) & (total > 0)
    report = spark.createDataFrame([(n,) for n in names], "held_out string")
    if not both.any():
        return report
    share = np.where(both[:, None], whole[:, None] / (2 * np.maximum(counts, 1)), 0.0)

    def weigh(batch) -> np.ndarray:
        return times(batch) * share[:, batch.column("y").to_numpy()]

    fits = [Fit(1.0 / max(n, 1), mean=m, deviation=d) for n, m, d in zip(whole, means, deviations)]
    tables = fit_many(alike, len(features), fits, weigh)
    told = predicted(marked.filter((F.col("y") == 1) | (F.col("level") <= int(place.max()))), len(features), tables, ["y"], lambda b: tested(b) & both[:, None], fits)
    scored = durable(told.join(numbers.withColumnRenamed("number", "model"), "model")
                     .select(F.col("scenario").alias("held_out"), F.col("y").alias("label"), F.col("scores")[1].alias("risk_score")))
    figures = Q.binary_metrics(scored, group=("held_out",)).join(Q.roc_auc(scored, group=("held_out",)), "held_out")
    return (report.join(figures, "held_out", "left")
            .withColumns({"test_attack_windows": F.col("tp") + F.col("fn"), "test_benign_windows": F.col("fp") + F.col("tn")}))


def score_and_publish(windows: DataFrame, models: Baseline, folder: str, signing_key: str,
                      threshold: float = ALERT_THRESHOLD) -> dict[str, str]:
    """Score windows and replace the window, alert and incident tables below ``folder``."""
    paths = {n: f"{folder.rstrip('/')}/{n}" for n in ("feature_vectors", "alerts", "incidents")}
    risk_score(windows, models.linear, threshold, models.forest).write.mode("overwrite").parquet(paths["feature_vectors"])
    scored = windows.sparkSession.read.parquet(paths["feature_vectors"])
    alerts = serving.alert_project(scored, threshold)
    write_alerts(alerts, paths["alerts"], signing_key)
    serving.alert_to_incident(alerts).write.mode("overwrite").parquet(paths["incidents"])
    return paths
