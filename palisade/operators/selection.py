"""Feature scores on the long presence table and selection by them.

All features share one contingency shuffle; cells for x = 0 follow from the class totals. Class totals are
one row per class and so are broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

FEATURE = "name"


def _class_totals(labels: DataFrame, label: str) -> DataFrame:
    return labels.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("total"))


def contingency(presence: DataFrame, labels: DataFrame, label: str = "label", feature: str = FEATURE) -> DataFrame:
    """Labelled samples that show a feature, for every feature and class including empty cells.

    One row per feature after the shuffle: a map from class to count, expanded against the class totals.
    """
    known = labels.select("sample_id", F.col(label).alias("label"))
    counts = (presence.join(known, "sample_id").groupBy(feature, "label").agg(F.count(F.lit(1)).alias("n"))
              .groupBy(feature).agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("_cells"),
                                    F.sum("n").alias("shown")))
    totals = _class_totals(labels, label).agg(
        F.sort_array(F.collect_list(F.struct("label", "total"))).alias("_classes"), F.sum("total").alias("samples"))
    classes, samples = totals.select("_classes"), totals.select("samples")
    rows = counts.withColumns({"samples": samples.scalar(), "_c": F.explode(classes.scalar())})
    return rows.select(feature, F.col("_c.label").alias("label"), F.col("_c.total").alias("total"), "samples", "shown",
                       F.coalesce(F.try_element_at("_cells", F.col("_c.label")), F.lit(0)).alias("n"))


def mutual_information(presence: DataFrame, labels: DataFrame, label: str = "label", feature: str = FEATURE) -> DataFrame:
    """Mutual information in nats of each 0/1 feature with the label."""
    cells = contingency(presence, labels, label, feature)
    n, shown, total, samples = (F.col(c).cast("double") for c in ("n", "shown", "total", "samples"))

    def part(joint, row, column):
        return F.when(joint > 0, joint / samples * F.log(joint * samples / (row * column))).otherwise(0.0)
    gain = part(n, shown, total) + part(total - n, samples - shown, total)
    return cells.groupBy(feature).agg(F.greatest(F.sum(gain), F.lit(0.0)).alias("mi"))


def _survival(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tails of the chi-square distribution for whole degrees of freedom: a finite sum, taken for all rows together."""
    half, odd = x / 2, df % 2 == 1
    tail, term = np.exp(-half), np.exp(-half)
    if odd.any():
        tail[odd] = [math.erfc(v) for v in np.sqrt(half[odd])]
        term[odd] = np.sqrt(half[odd]) * np.exp(-half[odd]) / math.gamma(1.5)
        tail = np.where(odd & (df > 1), tail + term, tail)
    steps = np.where(odd, (df - 1) // 2, df // 2)  # so many terms have been added, or are still to come
    for i in range(1, int(steps.max(initial=0))):
        term = term * half / (i + np.where(odd, 0.5, 0.0))
        tail = np.where(i < steps, tail + term, tail)
    return tail


def with_absent(scores: DataFrame, features: DataFrame, feature: str = FEATURE, **values: float) -> DataFrame:
    """Add features of the whole matrix that no scored sample shows, with the given values."""
    absent = features.select(feature).distinct().join(scores, feature, "left_anti")
    return scores.unionByName(absent.withColumns({k: F.lit(v) for k, v in values.items()}), allowMissingColumns=True)


def chi_square(presence: DataFrame, labels: DataFrame, label: str = "label", feature: str = FEATURE) -> DataFrame:
    """Chi-square of class-wise feature sums against class shares, with its p-value.

    A feature no sample shows has an undefined p-value; add such features by ``with_absent(..., p_value=nan)``.
    """
    cells = contingency(presence, labels, label, feature)
    expected = F.col("shown").cast("double") * F.col("total") / F.col("samples")
    stats = cells.groupBy(feature).agg(F.sum(F.pow(F.col("n") - expected, 2) / expected).alias("chi2"),
                                       (F.count(F.lit(1)) - 1).alias("df"))

    @F.pandas_udf("double")
    def p_value(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(_survival(x.to_numpy(float), df.to_numpy(int)))
    return stats.withColumn("p_value", p_value("chi2", "df"))


def mi_threshold(scores: DataFrame, threshold: float = 0.01) -> DataFrame:
    return scores.filter(F.col("mi") >= threshold)


def pvalue_filter(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Significant features; an undefined p-value is kept."""
    return scores.filter(F.col("p_value").isNull() | F.isnan("p_value") | (F.col("p_value") < alpha))


def top_k(scores: DataFrame, k: int = 25, score: str = "mi", feature: str = FEATURE) -> DataFrame:
    return scores.orderBy(F.desc(score), feature).limit(k)


def restrict(presence: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the listed samples."""
    return presence.join(ids.select("sample_id"), "sample_id", "left_semi")


def select_by_score(presence: DataFrame, labels: DataFrame, splits: DataFrame, threshold: float = 0.01,
                    label: str = "label") -> DataFrame:
    """Score features on the training samples and keep the selected ones in both parts."""
    train = splits.filter(F.col("split") == "train")
    scores = mutual_information(restrict(presence, train), restrict(labels, train), label)
    kept = presence.join(mi_threshold(scores, threshold).select(FEATURE), FEATURE, "left_semi")
    return kept.join(splits.select("sample_id", "split"), "sample_id")
