"""Quality figures of scores and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import seconds_between
from .ordering import running_total


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when there is nothing to divide by."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def binary_metrics(df: DataFrame, score: str = "risk_score", label: str = "label", threshold: float = 0.5,
                   group: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1 and false positive rate (null without negatives)."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    counted = df.groupBy(*group).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counted.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(tp * 2, tp * 2 + fp + fn),
        "false_positive_rate": F.when(fp + tn > 0, fp / (fp + tn))})


def roc_auc(df: DataFrame, score: str = "risk_score", label: str = "label", group: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve per group, null when a class is missing.

    Rows are first counted per distinct score; the running count of negatives below each score is
    kept distributed, and ties count half.
    """
    pos = F.col(label) == 1
    by_score = df.groupBy(*group, F.col(score).alias("_s")).agg(
        F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_q"))
    ranked = running_total(by_score, group, ("_s",), "_q", "_upto")
    won = F.col("_p") * (F.col("_upto") - F.col("_q") / 2)
    sums = ranked.groupBy(*group).agg(F.sum(won).alias("_u"), F.sum("_p").alias("_P"), F.sum("_q").alias("_N"))
    area = F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_u") / (F.col("_P").cast("double") * F.col("_N")))
    return sums.select(*group, area.alias("roc_auc"))


def average_ranks(df: DataFrame, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct score within its group (ties share the mean rank)."""
    by_score = df.groupBy(*group, score).agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(by_score, group, (score,), "n", "_upto")
    return upto.withColumn("rank", F.col("_upto") - (F.col("n") - 1) / 2).drop("_upto")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def multiclass_metrics(df: DataFrame, label: str, predicted: str, digits: int = 4) -> DataFrame:
    """Accuracy, balanced accuracy and weighted precision, recall and F1 from the confusion counts."""
    cells = confusion(df, label, predicted)
    per_class = (cells.select(F.explode(F.array(
        F.struct(F.col("actual").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("right")),
        F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"),
                 F.lit(0).cast("long").alias("right")))).alias("r")).select("r.*")
        .groupBy("c").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("right").alias("right")))
    right, said, support = F.col("right"), F.col("said"), F.col("support")
    precision, recall = _ratio(right, said), _ratio(right, support)
    f1 = _ratio(right * 2, said + support)

    def weighted(c: Column) -> Column:
        return F.sum(c * support) / F.sum(support)
    figures = {"accuracy": F.sum(right) / F.sum(support), "balanced_accuracy": F.avg(F.when(support > 0, recall)),
               "precision": weighted(precision), "recall": weighted(recall), "f1": weighted(f1)}
    return per_class.agg(*(F.round(v, digits).alias(k) for k, v in figures.items()))


def ovr_auc(df: DataFrame, label: str, scores: dict[int, str], digits: int = 4) -> DataFrame:
    """One-vs-rest AUC weighted by class size, null when a class has no rows or holds all of them."""
    cases = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(s).cast("double").alias("s"),
                                         F.when(F.col(label) == c, 1).otherwise(0).alias("y"))
                                for c, s in scores.items())))
    long = df.select(cases.alias("r")).select("r.*")
    sizes = long.groupBy("c").agg(F.sum("y").alias("n"))
    areas = roc_auc(long, "s", "y", ("c",)).join(sizes, "c")
    whole = F.count("roc_auc") == F.count(F.lit(1))
    value = F.sum(F.col("roc_auc") * F.col("n")) / F.sum("n")
    return areas.agg(F.round(F.when(whole, value), digits).alias("roc_auc"))


def lead_time(scored: DataFrame, annotations: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Seconds from the first alerting attack window to the annotated encryption start, per annotated source."""
    first = (scored.filter((F.col("label") == 1) & (F.col("risk_score") >= threshold))
             .groupBy("source").agg(F.min("window_start").alias("first_alert")))
    return (annotations.join(first, "source", "left")
            .withColumn("lead_seconds", seconds_between(F.col("encryption_start"), F.col("first_alert"))))


def holdout_average(per_scenario: DataFrame) -> DataFrame:
    """Mean figures over scenarios; missing false positive rates are left out."""
    return per_scenario.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1", "false_positive_rate")))
