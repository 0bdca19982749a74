"""Event filtering, process keys and per-process time windows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import file_extension, is_suspicious_path, normalize_path, path_lineage
from ..schemas import (EVENT_IDS, FILE_EVENT_IDS, NETWORK_EVENT_IDS, RAW_REPRESENTATION, REGISTRY_EVENT_IDS, WINDOW_FEATURES,
                       WINDOW_KEY, WINDOW_SECONDS, ZERO_GUID)

_WINDOW_TEXT = ("computer", "process_guid", "process_id", "image", "target_filename", "target_object",
                "destination_ip")


def conform_columns(df: DataFrame, names: Iterable[str] = _WINDOW_TEXT) -> DataFrame:
    """Text columns that always exist and are never null."""
    return df.withColumns({
        n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in df.columns else F.lit("") for n in names})


def coerce_timestamps(df: DataFrame, name: str = "timestamp") -> DataFrame:
    """Parse text timestamps and drop rows whose value does not parse."""
    if df.schema[name].dataType.typeName() == "string":
        df = df.withColumn(name, F.try_to_timestamp(F.col(name)))
    return df.filter(F.col(name).isNotNull())


def process_key() -> Column:
    """GUID, or ``process_id:image`` when the GUID is empty or all zero."""
    guid = F.col("process_guid")
    return F.when(guid.isin("", ZERO_GUID), F.concat_ws(":", "process_id", "image")).otherwise(guid)


def event_filter(df: DataFrame, event_ids: Iterable[int] = EVENT_IDS) -> DataFrame:
    """Supported events that have a timestamp and a process identifier; ``event_id`` becomes an int."""
    def given(name: str) -> Column:
        value = F.col(name)
        return F.coalesce(value != "", F.lit(False)) if df.schema[name].dataType.typeName() == "string" else value.isNotNull()
    return (df.withColumn("event_id", F.col("event_id").try_cast("int"))
            .filter(F.col("event_id").isin(*event_ids) & given("timestamp")
                    & (given("process_guid") | given("process_id"))))


def windowed_rows(events: DataFrame) -> DataFrame:
    """Events with the derived columns that windows group and count."""
    rows = conform_columns(coerce_timestamps(events)).withColumns(
        {"process_key": process_key(), "_path": normalize_path(F.col("target_filename"))})
    return rows.withColumns({"extension": file_extension(F.col("_path"), normalized=True),
                             "suspicious": is_suspicious_path(F.col("_path"), normalized=True)}).drop("_path")


# What one event contributes to its window: its id, a suspicious path, and values that count once per window.
DISTINCT_FACTS = {"unique_images": "image", "unique_files": "target_filename", "unique_extensions": "extension",
                  "unique_destination_ips": "destination_ip"}


def window_facts(rows: DataFrame, by: Sequence[str], keep: Sequence[str] = (), identity: str | None = None) -> DataFrame:
    """Events as narrow (kind, value) rows; empty values other than the image give none.

    ``keep`` columns stay on the row that stands for the event itself; ``identity`` stays on the rows that are
    counted per event, so that events can be told apart.
    """
    def fact(kind: str, value: str) -> str:
        kept = [f"if({kind == 'event'}, `{c}`, null) AS `{c}`" for c in keep]
        if identity:
            kept.append(f"if({kind in ('event', 'suspicious')}, {identity}, null) AS {identity}")
        return f"struct({', '.join([f'{kind!r} AS kind', f'{value} AS value', *kept])})"
    facts = [fact("event", "coalesce(string(event_id), '')"), fact("suspicious", "if(suspicious = 1, '', null)"),
             *(fact(kind, c if c == "image" else f"nullif({c}, '')") for kind, c in DISTINCT_FACTS.items())]
    return (rows.select(*by, F.expr(f"explode(array({', '.join(facts)})) AS f")).select(*by, "f.*")
            .filter(F.col("value").isNotNull()))


def window_totals(n: str) -> list[Column]:
    """The 17 behavioural features of one window from its facts, each standing for ``n`` events."""
    def events(condition: str) -> str:
        return f"coalesce(sum(if({condition}, {n}, null)), 0L)"

    def ids(chosen: Iterable[int]) -> str:
        return events("kind = 'event' AND value IN (%s)" % ", ".join(f"'{i}'" for i in chosen))
    totals = {"event_count": events("kind = 'event'"), **{k: f"count_if(kind = '{k}')" for k in DISTINCT_FACTS},
              "suspicious_path_count": events("kind = 'suspicious'"), "file_activity_count": ids(FILE_EVENT_IDS),
              "registry_activity_count": ids(REGISTRY_EVENT_IDS), "network_activity_count": ids(NETWORK_EVENT_IDS),
              **{f"event_{i}_count": ids([i]) for i in EVENT_IDS}}
    return [F.expr(f"{totals[f]} AS {f}") for f in WINDOW_FEATURES]


def count_features(rows: DataFrame, by: Sequence[str], extra: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Behavioural features per group, exact and in two steps.

    Equal facts are counted first, spread over (group, kind, value), so a busy group is combined before its
    rows meet, and the second step handles one row per different value. ``extra`` maps a name to
    (min | max | sum, column).
    """
    extra = extra or {}
    columns = sorted({c for _, c in extra.values()})
    apply = {"min": F.min, "max": F.max, "sum": F.sum}
    counted = window_facts(rows, by, columns).groupBy(*by, "kind", "value").agg(
        F.count(F.lit(1)).alias("_n"), *(apply[how](c).alias(f"_{name}") for name, (how, c) in extra.items()))
    return counted.groupBy(*by).agg(*window_totals("_n"),
                                    *(apply[how](f"_{name}").alias(name) for name, (how, _) in extra.items()))


def process_windows(events: DataFrame, window_seconds: int = WINDOW_SECONDS, slide_seconds: int | None = None,
                    extra: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per computer, process and UTC time window."""
    if window_seconds <= 0:
        raise ValueError("window_seconds must be positive")
    span = F.window("timestamp", f"{window_seconds} seconds", f"{slide_seconds} seconds" if slide_seconds else None)
    rows = windowed_rows(events).withColumn("window_start", span.getField("start"))
    return count_features(rows, WINDOW_KEY, extra)


def label_windows(windows: DataFrame, label: int, source_kind: str, source: Column,
                  dataset_source: str) -> DataFrame:
    """Attach label, lineage and provenance columns."""
    technique, scenario = path_lineage(source)
    return windows.withColumns({
        "label": F.lit(label), "technique_id": technique, "scenario": scenario, "source": source,
        "source_kind": F.lit(source_kind), "dataset_source": F.lit(dataset_source),
        "representation": F.lit(RAW_REPRESENTATION)})
