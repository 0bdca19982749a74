"""Histories of the last windows of a source or host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schemas import SEQUENCE_LENGTH
from .ordering import row_numbered, trailing

ORDER = ("window_start", "process_key")


def sequence_builder(df: DataFrame, features: Sequence[str], group: Sequence[str] = ("source",),
                     length: int = SEQUENCE_LENGTH, order: Sequence[str] = ORDER) -> DataFrame:
    """Add ``sequence``: the last ``length`` feature vectors up to each row, zero vectors in front."""
    vector = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    rows = trailing(df.withColumn("_v", vector), group, order, length,
                    lambda w: {"_s": F.collect_list("_v").over(w)})
    zeros = F.array_repeat(F.array(*(F.lit(0.0) for _ in features)), F.lit(length) - F.size("_s"))
    return rows.withColumn("sequence", F.concat(zeros, F.col("_s"))).drop("_v", "_s")


def seq_pooling(df: DataFrame, features: Sequence[str], group: Sequence[str] = ("source",),
                length: int = SEQUENCE_LENGTH, order: Sequence[str] = ORDER, absolute: bool = False) -> DataFrame:
    """Mean and maximum of each feature over the zero-padded sequence, as ``mean_*`` and ``max_*``.

    ``absolute`` adds the mean magnitude as ``abs_*``. Computed as frame aggregates, so the sequences
    themselves are never built.
    """
    def pooled(w):
        steps = F.count(F.lit(1)).over(w)
        out = {"steps": steps}
        for f in features:
            value = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
            top = F.max(value).over(w)
            out[f"mean_{f}"] = F.sum(value).over(w) / F.lit(float(length))
            if absolute:
                out[f"abs_{f}"] = F.sum(F.abs(value)).over(w) / F.lit(float(length))
            out[f"max_{f}"] = F.when(steps < length, F.greatest(top, F.lit(0.0))).otherwise(top)
        return out
    return trailing(df, group, order, length, pooled)


def history_asof(windows: DataFrame, is_current, group: Sequence[str] = ("computer",), key: str = "window_id",
                 length: int = SEQUENCE_LENGTH, order: Sequence[str] = ORDER) -> DataFrame:
    """For each current window, its last ``length`` windows of the same group, newest step = 1.

    Positions turn the as-of condition into an equality on (group, position), which spreads a busy
    group over all tasks.
    """
    placed = row_numbered(windows, group, order, "position")
    current = (placed.filter(is_current)
               .select(*group, F.col(key).alias(f"current_{key}"), F.col("position").alias("_at")))
    wanted = (current.withColumn("step", F.explode(F.sequence(F.lit(1), F.least(F.col("_at"), F.lit(length)))))
              .withColumn("position", F.col("_at") - F.col("step") + 1).drop("_at"))
    return wanted.join(placed, [*group, "position"])
