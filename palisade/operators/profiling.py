"""Sample metadata: counts, missing values, dates and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import colon_date, epoch_date

# Date given to samples nothing is known about, last year taken as valid.
DEFAULT_DATE = "2021-02-04"
LAST_YEAR = 2025
MIDNIGHT = "00:00:00"


def value_counts_pct(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage (2 digits) per value."""
    total = df.agg(F.count(column))
    return (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("pct", F.round(F.col("n") * 100 / total.scalar(), 2)))


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage per column, from one pass; without rows the percentage is null."""
    names = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in names))
    long = one.unpivot(["_n"], names, "column", "missing")
    return long.select("column", "missing", F.round(F.try_divide(F.col("missing") * 100, F.col("_n")), 2).alias("pct"))


def year_type_crosstab(df: DataFrame, date: str, kind: str, kinds: Sequence[int] = (0, 1)) -> DataFrame:
    """Rows per year and kind, 0 where there are none."""
    years = df.filter(F.col(date).isNotNull()).groupBy(F.year(date).alias("year"))
    return years.agg(*(F.count_if(F.col(kind) == k).alias(f"{kind}_{k}") for k in kinds))


def year_range(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(F.year(date)).alias("min_year"), F.max(F.year(date)).alias("max_year"))


def year_bounds_null(df: DataFrame, date: str, others: Sequence[str] = (), last_year: int = LAST_YEAR) -> DataFrame:
    """Null the date columns of rows dated after ``last_year``; rows without a date stay as they are."""
    valid = F.coalesce(F.year(date) <= last_year, F.lit(True))
    return df.withColumns({c: F.when(valid, F.col(c)) for c in (*others, date)})


def missing_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def group_mode(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent non-null value per group, the smallest on ties.

    Counting per value comes first, so a group never gathers all its values in one buffer.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group).agg(F.max("n").alias("n"))
    return (counts.join(best, [group, "n"]).groupBy(group).agg(F.min(value).alias("mode")))


def mode_impute(df: DataFrame, value: str, kind: str = "sample_type", family: str = "ransomware_family",
                source: str = "source", default: str = DEFAULT_DATE) -> DataFrame:
    """Fill missing values with the mode of the family (kind 1) or the source (kind 0), then a constant."""
    by_family = group_mode(df, family, value).select(family, F.col("mode").alias("_family_mode"))
    by_source = group_mode(df, source, value).select(source, F.col("mode").alias("_source_mode"))
    filled = F.coalesce(F.col(value), F.when(F.col(kind) == 1, F.col("_family_mode"))
                        .when(F.col(kind) == 0, F.col("_source_mode")),
                        F.lit(default).cast(df.schema[value].dataType))
    return (df.join(by_family, family, "left").join(by_source, source, "left")
            .withColumn(value, filled).drop("_family_mode", "_source_mode"))


def parse_submission(text: Column, colon_first: Column) -> Column:
    """Date from colon-separated or epoch-second text, the other form as fallback; '00:00:00' is missing."""
    known = F.nullif(text, F.lit(MIDNIGHT))
    return F.when(colon_first, F.coalesce(colon_date(known), epoch_date(known))).otherwise(epoch_date(known))


def timestamp_history(cleaned: DataFrame, original: DataFrame, key: str, value: str) -> DataFrame:
    """Cleaned rows next to the value they had before."""
    return cleaned.join(original.select(key, F.col(value).alias(f"old_{value}")), key)


def class_test_quota(df: DataFrame, kind: str, share: float = 0.2) -> DataFrame:
    """Rows per class and how many of them are for testing and training (half rounds to even)."""
    counts = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    test = F.bround(F.col("n") * share).cast("long")
    return counts.withColumn("test", test).withColumn("train", F.col("n") - F.col("test"))


def family_type_map(df: DataFrame, key: str = "sample_id", family: str = "ransomware_family",
                    kind: str = "ransomware_type") -> DataFrame:
    """Type of each family; the row with the largest key wins."""
    return df.groupBy(family).agg(F.max_by(kind, key).alias(kind))


def goodware_join(description: DataFrame, metadata: DataFrame) -> DataFrame:
    """Descriptions of goodware samples with the metadata columns they lack."""
    keys = ["sample_id", "md5"]
    new = [c for c in metadata.columns if c in keys or c not in description.columns]
    return description.join(metadata.filter(F.col("sample_type") == 0).select(*new), keys)
