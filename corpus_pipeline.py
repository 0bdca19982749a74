"""The corpus pipeline: language identification, near-duplicate removal, surrogates for personal data, mixing of sources, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. ``run`` writes each
stage's result as Parquet below the shared folder and hands it to the next stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm.common import scratch_path, table
from palisade.llm.language_id import fit, identify
from palisade.llm.mixing import mix
from palisade.llm.near_dedup import NearDedup, near_rows, text_marks
from palisade.llm.packing import pack
from palisade.llm.surrogates import replace

#: The key of the surrogates; a production job passes its own, from its secret store.
SURROGATE_KEY = "corpus-surrogates"
#: Stages link at a similarity of 0.8 or more; more and shorter bands, so that a link at 0.8 is missed with a chance of 1.4e-7.
NEAR = NearDedup(percent=80, bands=52, rows=6)
ORACLE_SQL = None  # fitted models, keyed surrogates and dynamic programming have no SQL twin


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as ``doc`` with a key of its values, which only equal rows share."""
    return docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(*docs.columns).alias("row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, in all columns as they were.

    Those go whose text has no letter (null and empty ones too) or whose most probable language is less likely than all others together.
    """
    keyed = _keyed(docs)
    rows = keyed.select("row", "doc.text", F.col("doc.lang").alias("declared"), F.col("doc.source").alias("host"))
    rejected = identify(rows, fit(docs.select("text", "lang"))).filter(~F.coalesce("accepted", F.lit(False))).select("row").distinct()
    return keyed.join(rejected, "row", "left_anti").select("doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (``NEAR``), the one with the least doc_id; a row goes only as a near duplicate of one that stays.

    Rows of one doc_id with unlike texts all stay. Of rows that share doc_id and text one stays; rows without doc_id all stay.
    """
    found = near_rows(docs, NEAR)
    if "stays" not in found.columns:
        return docs.join(found.filter(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    marks = {f"_{name}": mark for name, mark in text_marks().items()}
    go = found.filter(~F.col("stays")).select(F.col("doc_id").alias("_id"), F.col("m1").alias("_g1"), F.col("m2").alias("_g2"))
    left = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", *(mark.alias(name) for name, mark in marks.items()))
    same = (F.col("doc_id") == F.col("_id")) & (F.col("_m1") == F.col("_g1")) & (F.col("_m2") == F.col("_g2"))
    left = left.join(go, same, "left_anti")
    one = left.filter("doc_id is not null").groupBy("doc_id", "_m1", "_m2").agg(F.max("doc").alias("doc"))
    return one.select("doc.*").unionByName(left.filter("doc_id is null").select("doc.*"))


def surrogate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced; ``n_chars`` follows a changed text. Null texts stay null."""
    new = replace(docs.select(F.struct(*docs.columns).alias("doc"), "text"), SURROGATE_KEY)
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("entities") > 0, F.length("text")).otherwise(F.col("doc.n_chars")).cast("long")}
    return new.select(*(changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it does not take go, and so do those without words."""
    keyed = _keyed(docs)
    taken = mix(keyed.select(F.col("row").alias("doc_id"), "doc.text", "doc.source")).filter("taken > 0")
    times = taken.groupBy("doc_id").agg(F.sum(F.expr("taken div size")).cast("int").alias("times")).withColumnRenamed("doc_id", "row")
    repeated = keyed.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row")
    if not repeated.isEmpty():  # equal rows were counted one by one; one of them stands for all
        one = keyed.join(repeated, "row", "left_semi").groupBy("row").agg(F.max("doc").alias("doc")).select("doc", "row")
        keyed = keyed.join(repeated, "row", "left_anti").select("doc", "row").unionByName(one)
    return keyed.join(times, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each sequence, with its length bucket, batch and place in the batch."""
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("surrogates", surrogate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        path = scratch_path(spark, f"stage-{stage[0]}")
        stage[1](spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)
    return reduce(step, STAGES, table(spark, sf_dir, "documents"))
