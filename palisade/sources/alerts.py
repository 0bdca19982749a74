"""Signed alert tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import hmac_sha256
from ..operators.ordering import row_numbered

SIGNATURE = "sig"
CONTENT = "payload"
NUMBER = "seq"
ROW = f"{NUMBER} long, {CONTENT} string, {SIGNATURE} string"
MANIFEST = f"table_id string, rows long, {SIGNATURE} string"


def canonical_json(columns: list[str]) -> Column:
    """JSON object with keys in alphabetical order."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def _row_signature(table_id: str, key: str) -> Column:
    """A row's signature binds its content to its place and its table."""
    return hmac_sha256(F.concat_ws("|", F.lit(table_id), F.col(NUMBER), F.col(CONTENT)), key)


def sign_alerts(alerts: DataFrame, key: str, table_id: str) -> DataFrame:
    """Each alert as canonical JSON with its number from 1, by content, and its HMAC-SHA256; rows are signed in parallel."""
    content = alerts.select(canonical_json(alerts.columns).alias(CONTENT))
    numbered = row_numbered(content, (), (CONTENT,), NUMBER)
    return numbered.select(F.col(NUMBER).cast("long").alias(NUMBER), CONTENT).withColumn(SIGNATURE, _row_signature(table_id, key))


def check_signatures(signed: DataFrame, key: str, table_id: str) -> DataFrame:
    """Add ``verified``: whether the row carries the right signature for its content, number and table."""
    return signed.withColumn("verified", F.coalesce(F.col(SIGNATURE) == _row_signature(table_id, key), F.lit(False)))


def _manifest(path: str) -> str:
    return path.rstrip("/") + ".manifest"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """JSON rows, or None when the path does not exist."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _signed_count(spark: SparkSession, table_id: str, rows: int, key: str) -> DataFrame:
    one = spark.createDataFrame([(table_id, rows)], "table_id string, rows long")
    return one.withColumn(SIGNATURE, hmac_sha256(F.concat_ws("|", F.lit("manifest"), "table_id", "rows"), key))


def write_alerts(alerts: DataFrame, path: str, key: str, table_id: str | None = None) -> str:
    """Signed alerts as JSON lines, and beside them the signed number of rows. Each table has an id of its own, so rows cannot move between tables."""
    spark, table_id = alerts.sparkSession, table_id or uuid.uuid4().hex
    sign_alerts(alerts, key, table_id).write.mode("overwrite").json(path)
    rows = spark.read.schema(ROW).json(path).count()
    _signed_count(spark, table_id, rows, key).write.mode("overwrite").json(_manifest(path))
    return path


def _refuse(why: str) -> RuntimeError:
    return RuntimeError(f"Alert signature verification failed: {why}.")


def read_alerts(spark: SparkSession, path: str, key: str, schema: str, legacy: bool = True) -> DataFrame:
    """Verified alerts; a table that is not there has no rows.

    Refused at once: a signed table without its manifest, a manifest that is not right, rows without signature in a signed table, and
    rows removed, added or repeated (their numbers must be 1 to the signed count, each once). A changed row fails the job that
    reads it. A table without any signature and manifest is of the old form and passes, unless ``legacy`` is false.
    """
    rows, manifest = _read(spark, path, f"{ROW}, {schema}"), _read(spark, _manifest(path), MANIFEST)
    if rows is None and manifest is None:
        return spark.createDataFrame([], schema)
    if rows is None:
        raise _refuse("the table of a manifest is missing")
    own = [c for c in rows.columns if c not in (NUMBER, CONTENT, SIGNATURE)]
    bare = F.col(SIGNATURE).isNull() & F.col(CONTENT).isNull()
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(bare).alias("bare"), F.countDistinct(NUMBER).alias("numbers"),
                     F.min(NUMBER).alias("low"), F.max(NUMBER).alias("high")).first()
    if manifest is None:
        if found["bare"] != found["n"] or not legacy:
            raise _refuse("the manifest is missing")
        return rows.select(*own)
    said = manifest.first()
    if said is None or said[SIGNATURE] != _signed_count(spark, said["table_id"], said["rows"], key).first()[SIGNATURE]:
        raise _refuse("the manifest was modified")
    whole = found["numbers"] == found["n"] == said["rows"] and (not found["n"] or (found["low"], found["high"]) == (1, said["rows"]))
    if found["bare"] or not whole:
        raise _refuse("rows were removed, added or replaced")
    checked = check_signatures(rows, key, said["table_id"])
    trusted = F.when(F.col("verified"), F.col(CONTENT)).otherwise(F.raise_error(F.lit("Alert signature verification failed: the table was modified.")))
    return checked.select(F.from_json(trusted, schema, {"mode": "FAILFAST"}).alias("a")).select("a.*")
