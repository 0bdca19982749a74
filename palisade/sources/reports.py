"""Sandbox and anti-virus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import AV_REPORT_SCHEMA, REPORT_SCHEMA

CORRUPT = "_corrupt_record"


def report_json_scan(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Reports with ``sample_id``: digits of the file name, or a field when files hold one report per line.

    Malformed files are rows with ``_corrupt_record`` set; split them off with ``readable`` / ``malformed``.
    """
    fields = [*REPORT_SCHEMA.fields, StructField(CORRUPT, StringType())]
    if not one_per_file:
        fields.insert(0, StructField("sample_id", StringType()))
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=one_per_file)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # parsed by a generator: a condition on a report cannot be drawn below it, where it would parse once more
    rows = raw.select(F.col("_metadata.file_name").alias("file_name"), F.explode(F.array(F.from_json("value", StructType(fields), options))).alias("r"))
    sample = F.regexp_extract("file_name", r"^(\d+)", 1) if one_per_file else F.col("r.sample_id")
    return rows.select(sample.try_cast("long").alias("sample_id"), *(f"r.{f.name}" for f in REPORT_SCHEMA.fields), f"r.{CORRUPT}")


def readable(reports: DataFrame) -> DataFrame:
    return reports.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def malformed(reports: DataFrame) -> DataFrame:
    return reports.filter(F.col(CORRUPT).isNotNull()).select("sample_id", CORRUPT)


def av_report_project(reports: DataFrame, text: str = "report", keep: tuple[str, ...] = ()) -> DataFrame:
    """Ten columns of an anti-virus report given as JSON text."""
    a = reports.withColumn("r", F.from_json(text, AV_REPORT_SCHEMA))
    stats, verdict = F.col("r.attributes.last_analysis_stats"), F.try_element_at("r.attributes.sandbox_verdicts", F.lit("C2AE"))
    plain = ("creation_date", "first_submission_date", "md5", "sha1", "sha256", "type_extension")
    total = F.aggregate(F.coalesce(F.map_values(stats), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda s, v: s + v)
    return a.select(*keep, *(F.col(f"r.attributes.{c}").alias(c) for c in plain),
                    F.try_element_at(stats, F.lit("malicious")).alias("malicious"), total.alias("total_avi_tested"),
                    *(F.try_element_at(verdict[n], F.lit(1)).alias(n) for n in ("malware_names", "malware_classification")))
