"""Risk of a whole sequence of windows: mean and max pooling under a logistic layer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sigmoid
from ..schemas import SEQUENCE_LENGTH
from ..session import durable
from .models import Scaler, fit_scaler, train_logistic
from .sequences import ORDER, seq_pooling

# Fixed value: attributions of one alert add up to this.
IMPORTANCE_TOTAL = 10.0


@dataclass(frozen=True)
class SequenceModel:
    """Window scaler and one weight per pooled mean and pooled maximum of each feature."""

    scaler: Scaler
    mean_weights: tuple[float, ...]
    max_weights: tuple[float, ...]
    intercept: float
    length: int = SEQUENCE_LENGTH

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for f, m, x in zip(self.scaler.features, self.mean_weights, self.max_weights):
            total = total + F.lit(m) * F.col(f"mean_{f}") + F.lit(x) * F.col(f"max_{f}")
        return sigmoid(total)


def train_sequence(train: DataFrame, features: Sequence[str], group: Sequence[str] = ("source",),
                   order: Sequence[str] = ORDER, length: int = SEQUENCE_LENGTH) -> SequenceModel:
    """Scale windows, pool each row's sequence and fit the logistic layer on the row's label."""
    scaler = fit_scaler(train, features)
    pooled = durable(seq_pooling(scaler.transform(train.select("label", *group, *order, *features)), features, group, length, order))
    names = [f"{kind}_{f}" for kind in ("mean", "max") for f in features]
    layer = train_logistic(pooled, names)
    inner = [c / d for c, d in zip(layer.coefficients, layer.scaler.deviation)]  # fold the layer's own scaling
    shift = sum(w * m for w, m in zip(inner, layer.scaler.mean))
    n = len(features)
    return SequenceModel(scaler, tuple(inner[:n]), tuple(inner[n:]), layer.intercept - shift, length)


def sequence_score(windows: DataFrame, model: SequenceModel, group: Sequence[str] = ("computer",),
                   order: Sequence[str] = ORDER, absolute: bool = False) -> DataFrame:
    """Add ``risk_score`` of the sequence that ends at each window, and its pooled values."""
    pooled = seq_pooling(model.scaler.transform(windows), model.scaler.features, group, model.length, order, absolute)
    return pooled.withColumn("risk_score", model.score())


def sequence_attribution(scored: DataFrame, model: SequenceModel, key: str) -> DataFrame:
    """Mean over steps of |gradient x input| per feature, scaled to a total of 10 per alert.

    ``scored`` comes from ``sequence_score(..., absolute=True)``. Each step feeds the mean; the largest step
    also feeds the maximum, so magnitudes of all steps and the largest value suffice.
    """
    def share(f: str, mean_weight: float, max_weight: float) -> Column:
        every = mean_weight / model.length
        top = F.abs(F.col(f"max_{f}"))
        others = F.col(f"abs_{f}") * model.length - top
        return F.lit(abs(every)) * others + F.lit(abs(every + max_weight)) * top
    parts = F.array(*(F.struct(F.lit(f).alias("feature_name"), share(f, m, x).alias("v"))
                      for f, m, x in zip(model.scaler.features, model.mean_weights, model.max_weights)))
    long = scored.select(key, F.explode(parts).alias("e")).select(key, "e.*")
    total = F.sum("v").over(Window.partitionBy(key))  # one row per feature in a partition
    return long.select(key, "feature_name",
                       F.when(total > 0, F.col("v") / total * IMPORTANCE_TOTAL).otherwise(F.col("v")).alias("importance_value"))
