"""Session defaults and the shared folder used to cut lineage or exchange tables between jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def build_session(cores: str = "*", partitions: int = 8, app: str = "palisade") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session to every function."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for local test sessions."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
    return _LOCAL_DIRS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="palisade-"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/palisade/{label}-{uuid.uuid4().hex}"
    if _MADE.get() is not None:
        _MADE.get().append(path)
    return path


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    context = spark.sparkContext
    known = context._jvm.org.apache.hadoop.fs.Path(path)
    return known.getFileSystem(context._jsc.hadoopConfiguration()), known


@contextmanager
def temporary_scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread makes below the shared folder inside the block are removed at its end."""
    token = _MADE.set([])
    try:
        yield
    finally:
        made = _MADE.get()
        _MADE.reset(token)
        for path in made:
            fs, known = file_system(spark, path)
            fs.delete(known, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables below ``<shared folder>/palisade``; call it when no result that was made from them is still to be read."""
    fs, path = file_system(spark, f"{shared_dir(spark)}/palisade")
    fs.delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: short lineage that survives lost executors.

    A compressed columnar table, so later reads fetch only the columns they need.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
