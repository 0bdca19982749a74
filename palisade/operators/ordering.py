"""Ordered analytics that stay distributed when one group holds most rows.

A plain analytic window sorts a whole group in one task. Here rows are range-partitioned on
(group, order), so a hot group spreads over many tasks; per-partition totals (at most one row
per group and partition) carry positions and sums across partition borders, and frames over
previous rows work on equal-sized blocks that borrow the few rows before them.
The range-partitioned rows are checkpointed once so that both uses see the same borders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

_LOCAL = (1 << 33) - 1  # monotonically_increasing_id keeps the row index in the low 33 bits


def _placed(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    keys = [*(F.col(g) for g in group), *(F.col(o) if isinstance(o, str) else o for o in order)]
    ranged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_id", F.monotonically_increasing_id()))
    return (durable(ranged)
            .withColumn("_part", F.shiftright("_id", 33))
            .withColumn("_pos", F.col("_id").bitwiseAND(F.lit(_LOCAL))).drop("_id"))


def _shifted(placed: DataFrame, group: Sequence[str], total: Column, base: Column) -> DataFrame:
    """Join to each row ``_shift``: total of the group's earlier partitions minus ``base`` of its own."""
    spans = placed.groupBy(*group, "_part").agg(total.alias("_total"), base.alias("_base"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_total").over(earlier), F.lit(0)) - F.col("_base")).alias("_shift")
    right = spans.select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col("_part").alias("_g_part"), shift)
    if not group:
        right = F.broadcast(right)  # one row per shuffle partition
    matched = F.col("_part") == F.col("_g_part")
    for g in group:
        matched = matched & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return placed.join(right, matched).drop("_g_part", *(f"_g_{g}" for g in group))


def row_numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """Exact 1-based position of each row within its group."""
    shifted = _shifted(_placed(df, group, order), group, F.count(F.lit(1)), F.min("_pos"))
    return shifted.withColumn(name, F.col("_pos") + F.col("_shift") + 1).drop("_pos", "_part", "_shift")


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], value: str,
                  name: str) -> DataFrame:
    """Sum of ``value`` over the group's rows up to and including the current one."""
    shifted = _shifted(_placed(df, group, order), group, F.sum(value), F.lit(0))
    here = (Window.partitionBy(*group, "_part").orderBy("_pos")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (shifted.withColumn(name, F.sum(value).over(here) + F.col("_shift"))
            .drop("_pos", "_part", "_shift"))


def trailing(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], length: int,
             columns: Callable[[Window], dict[str, Column]], block_rows: int = 8192,
             keep_rn: str | None = None) -> DataFrame:
    """Add columns computed over the current row and the ``length - 1`` rows before it in its group."""
    block_rows = max(block_rows, length)
    ranked = row_numbered(df, group, order, "_rn")
    index = (F.col("_rn") - 1).cast("long")
    home = F.floor(index / F.lit(block_rows))
    lends = index % block_rows >= block_rows - (length - 1)
    blocks = F.when(lends, F.array(home, home + 1)).otherwise(F.array(home))
    spread = ranked.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    frame = Window.partitionBy(*group, "_block").orderBy("_rn").rowsBetween(-(length - 1), 0)
    out = spread.withColumns(columns(frame)).filter(F.col("_home") == F.col("_block")).drop("_home", "_block")
    return out.withColumnRenamed("_rn", keep_rn) if keep_rn else out.drop("_rn")
