"""Fixed-row-count windows over an ordered event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keyword_hit, short_extension
from ..schemas import EVENT_IDS, FILE_EVENT_IDS, RAW_REPRESENTATION, REGISTRY_EVENT_IDS
from .ordering import row_numbered

# Fixed value: synthetic start of the first window.
FIRST_WINDOW = "2026-08-06 00:00:00"


def chunk_index(df: DataFrame, order: Sequence[str | Column], rows: int, name: str = "chunk") -> DataFrame:
    """0-based number of the run of ``rows`` consecutive rows each row falls into."""
    numbered = row_numbered(df, (), order, "_rn")
    return numbered.withColumn(name, F.floor((F.col("_rn") - 1) / F.lit(rows))).drop("_rn")


def count_windows(df: DataFrame, order: Sequence[str | Column], rows: int = 10, dataset: str = "event_log",
                  computer: str = "endpoint-01") -> DataFrame:
    """One window per ``rows`` consecutive events with columns ``class, code, image, target, command_line``.

    Sets and the label mode are collected per window, so they never hold more than ``rows`` values.
    """
    code = F.coalesce(F.col("code").try_cast("int"), F.lit(0))

    def hits(ids: Sequence[int]) -> Column:
        return F.count_if(code.isin(*ids))

    def different(c: Column) -> Column:
        return F.size(F.collect_set(c)).cast("long")

    named = [o for o in order if isinstance(o, str)]
    if len(named) == len(order):  # only what is counted is numbered and moved
        df = df.select(*dict.fromkeys(["class", "code", "image", "target", "command_line", *named]))
    chunked = chunk_index(df, order, rows)
    counted = chunked.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("event_count"),
        different(F.col("image")).alias("unique_images"),
        different(F.col("target")).alias("unique_files"),
        different(short_extension(F.col("target"))).alias("unique_extensions"),
        F.when(hits([3]) > 0, different(F.col("target"))).otherwise(F.lit(0).cast("long"))
        .alias("unique_destination_ips"),
        F.count_if(keyword_hit(F.col("command_line"))).alias("suspicious_path_count"),
        hits(FILE_EVENT_IDS).alias("file_activity_count"),
        hits(REGISTRY_EVENT_IDS).alias("registry_activity_count"),
        hits([3]).alias("network_activity_count"),
        *(hits([i]).alias(f"event_{i}_count") for i in EVENT_IDS),
        F.mode("class", True).alias("label"),
    )
    start = F.lit(FIRST_WINDOW).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.col("chunk") * rows).cast("decimal(18,6)"))
    kind = F.when(F.col("label") == 0, "benign").otherwise("attack")
    return counted.select(
        start.alias("window_start"), F.lit(computer).alias("computer"),
        F.format_string("PROC-%05d", "chunk").alias("process_key"),
        *(c for c in counted.columns if c not in ("chunk", "label")), "label",
        kind.alias("scenario"),
        F.concat(F.lit(dataset + "_log_"), F.col("chunk") % 5 + 1).alias("source"),
        kind.alias("source_kind"), F.lit(dataset).alias("dataset_source"),
        F.lit(RAW_REPRESENTATION).alias("representation"))
