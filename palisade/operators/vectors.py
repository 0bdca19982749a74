"""Model input columns: selection, vectorising, alignment and JSON packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from ..schemas import IDENTIFIER_COLUMNS


def feature_columns(df: DataFrame, exclude: frozenset[str] = IDENTIFIER_COLUMNS) -> list[str]:
    """Numeric columns that are not identifiers, in frame order."""
    return [f.name for f in df.schema if f.name not in exclude and isinstance(f.dataType, NumericType)]


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name)


def vectorize(df: DataFrame, keep: Sequence[str] = (), exclude: frozenset[str] = IDENTIFIER_COLUMNS) -> DataFrame:
    """``keep`` plus all features as doubles, missing values as 0."""
    return df.select(*keep, *(_number(c) for c in feature_columns(df, exclude) if c not in keep))


def align_to_model(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's columns in its order; absent columns and missing values are 0."""
    return df.select(*keep, *(_number(n) if n in df.columns else F.lit(0.0).alias(n) for n in names))


def assemble(df: DataFrame, names: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol=name, handleInvalid="keep").transform(df)


def pack_features(df: DataFrame, names: Sequence[str], name: str = "features_json") -> DataFrame:
    """Non-null features as one JSON object."""
    entries = F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names))
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    return df.withColumn(name, F.to_json(F.map_from_entries(present))).drop(*names)


def unpack_features(df: DataFrame, names: Sequence[str], name: str = "features_json") -> DataFrame:
    """Features back as columns; they win over metadata of the same name, unreadable JSON gives none."""
    packed = F.coalesce(F.from_json(name, "map<string,double>"), F.create_map().cast("map<string,double>"))
    wide = df.withColumn("_map", packed)

    def value(n: str) -> Column:
        found = F.try_element_at(F.col("_map"), F.lit(n))
        return F.coalesce(found, F.col(n).cast("double")) if n in df.columns else found
    return wide.withColumns({n: value(n) for n in names}).drop("_map")
