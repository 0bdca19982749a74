"""Live steps that take a host's rows in order, as one ordinary job a micro-batch.

A keyed processor sees all rows of a host in one task. Here a micro-batch is a table: the ordering kernel spreads a hot host
over many tasks, and what a host leaves behind is a row or a few of a state table. Batch N reads the state
that batch N - 1 left and writes its own next to it before its output, so a batch that is run again after a failure finds
what it found before and overwrites what it wrote. The state is written whole once a batch; it is bounded a host.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import file_system, scratch_path, temporary_scratch

State = dict[str, DataFrame]


def _unchanged(rows: DataFrame) -> DataFrame:
    return rows


@dataclass(frozen=True)
class OrderedJob:
    """``step(batch, state)`` gives the rows to append and the state tables for the next batch; ``state`` names their schemas."""

    stream: DataFrame
    step: Callable[[DataFrame, State], tuple[DataFrame, State]]
    rows: str
    state: Mapping[str, str]
    last: Callable[[DataFrame], DataFrame] = _unchanged

    @property
    def sparkSession(self) -> SparkSession:
        return self.stream.sparkSession

    @property
    def schema(self) -> T.StructType:
        return self.last(self.sparkSession.createDataFrame([], self.rows)).schema

    def then(self, change: Callable[[DataFrame], DataFrame]) -> OrderedJob:
        """The same job with ``change`` applied to what it appends."""
        before = self.last
        return replace(self, last=lambda rows: change(before(rows)))

    def start(self, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Append to a Parquet table whose folders are named by batch (column ``batch``)."""
        spark = self.sparkSession
        base = f"{checkpoint.rstrip('/')}/ordered"

        def run(batch: DataFrame, number: int) -> None:
            with temporary_scratch(spark):
                copy = scratch_path(spark, "batch")
                batch.write.parquet(copy)  # read once only, however many steps follow
                held = {n: spark.read.schema(s).parquet(f"{base}/{n}/{number - 1}") if number else spark.createDataFrame([], s)
                        for n, s in self.state.items()}
                output, left = self.step(spark.read.schema(batch.schema).parquet(copy), held)
                for name, table in left.items():
                    table.write.mode("overwrite").parquet(f"{base}/{name}/{number}")
                self.last(output).write.mode("overwrite").parquet(f"{path}/batch={number}")
            for name in self.state:  # the state before the last can be asked for no more
                fs, old = file_system(spark, f"{base}/{name}/{number - 2}")
                fs.delete(old, True)

        fs, folder = file_system(spark, path)
        fs.mkdirs(folder)
        writer = self.stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
