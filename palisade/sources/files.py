"""Plain file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import path_lineage

# Files that are never hashed, log phrases that are no errors.
IGNORED_FILE = "desktop.ini"
HARMLESS_ERRORS = ("WARNING: Error", "Error dumping file from path", "ERROR: Failed to run 'on_call'",
                   "Error returned by is32bit")


def source_discovery(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files below ``root`` by name pattern, with size and lineage; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
             .load(root).select("path", "length"))
    technique, scenario = path_lineage(F.col("path"))
    return files.withColumns({"technique_id": technique, "scenario": scenario})


def csv_scan(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header and declared types."""
    return spark.read.schema(schema).option("header", "true").option("sep", sep).csv(path)


def csv_sink(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)
    return path


def parquet_sink(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def json_to_jsonl(spark: SparkSession, source: str, target: str, schema: str | None = None) -> DataFrame:
    """Files holding a JSON array or one object each become one JSON object per line."""
    reader = spark.read.option("multiLine", "true").option("mode", "FAILFAST").option("recursiveFileLookup", "true")
    (reader.schema(schema) if schema else reader).json(source).write.mode("overwrite").json(target)
    return spark.read.schema(schema).json(target) if schema else spark.read.json(target)


def binary_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256, SHA-1 and MD5 of the visible files in the folder or folders of a pattern; each file is one row in memory."""
    name = F.element_at(F.split("path", "/"), -1)
    base = folder.split("/*")[0]
    files = spark.read.format("binaryFile").option("basePath", base).load(folder).withColumn("filename", name)
    visible = ~(name.startswith(".") | name.startswith("~$") | (name == IGNORED_FILE))
    keep = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content", "filename")]  # of partitioned folders
    return files.filter(visible).select(*keep, "filename", F.sha2("content", 256).alias("sha256"),
                                        F.sha1("content").alias("sha1"), F.md5("content").alias("md5"))


def log_errors(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines that report an error and carry none of the harmless phrases."""
    line = F.col(text)
    found = lines.filter(line.rlike(r"(?i)\berror\b:?"))
    for phrase in HARMLESS_ERRORS:
        found = found.filter(~F.contains(line, F.lit(phrase)))
    return found


def log_error_screen(runs: DataFrame, lines: DataFrame, key: str = "run_id", text: str = "value") -> DataFrame:
    """Runs whose log shows no error."""
    return runs.join(log_errors(lines, text).select(key), key, "left_anti")
