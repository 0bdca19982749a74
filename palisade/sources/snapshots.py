"""Tables that are replaced as a whole while others read them.

A refresh writes a new snapshot beside the old one and then makes an empty marker file, whose name holds the version and the folder.
Making the marker is the only step a reader can see, so a reader gets the old rows or the new ones, never a part and never none; a
refresh that fails leaves a folder without a marker, which nobody reads. Work that began on an old snapshot can end as long as that
snapshot is kept (``expire``).

A table has one refreshing job at a time: where two make the same version, readers agree on one of them, and the other ``upsert`` fails with
``ConcurrentRefresh`` and is to be run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import file_system

_MARKERS, _DATA = "_commits", "data"


class ConcurrentRefresh(RuntimeError):
    """Another job made the same version; run the refresh again."""


def versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """All committed versions of a table, oldest first, as (number, folder)."""
    fs, known = file_system(spark, f"{root}/{_MARKERS}")
    names = sorted(f.getPath().getName() for f in fs.listStatus(known)) if fs.exists(known) else []
    return [(int(n.split("-")[0]), f"{root}/{_DATA}/{n}") for n in names if n[:1].isdigit()]


def read_snapshot(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame | None:
    """The newest snapshot, None where there is none yet. The result keeps reading that snapshot, whatever is published after."""
    known = versions(spark, root)
    if not known:
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(known[-1][1])


def _publish(df: DataFrame, root: str, number: int, partition_by: Sequence[str]) -> str:
    spark, name = df.sparkSession, f"{number:012d}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{root}/{_DATA}/{name}")
    fs, marker = file_system(spark, f"{root}/{_MARKERS}/{name}")
    fs.mkdirs(marker.getParent())
    if not fs.createNewFile(marker):
        raise ConcurrentRefresh(f"version {number} of {root} is there already")
    return name


def publish(df: DataFrame, root: str, partition_by: Sequence[str] = ()) -> int:
    """Make ``df`` the table's rows, as a new version; its number is returned. An empty ``df`` makes an empty table."""
    known = versions(df.sparkSession, root)
    number = known[-1][0] + 1 if known else 1
    _publish(df, root, number, partition_by)
    return number


def upsert(rows: DataFrame, root: str, keys: Sequence[str], replace: bool = True, partition_by: Sequence[str] = ()) -> int:
    """Add ``rows`` to the table as a new version; its number is returned.

    Of a key that the table has already, the new rows stay (``replace``) or the stored ones; rows of one key go together. Null keys are keys like others. Run again with the same
    rows, it leaves the table's rows as they are. Both sides meet in one join on the keys.
    """
    spark = rows.sparkSession
    known = versions(spark, root)
    if not known:
        merged, number = rows, 1
    else:
        stored, number = spark.read.parquet(known[-1][1]).select(*rows.columns), known[-1][0] + 1
        kept, other = (rows, stored) if replace else (stored, rows)
        left, right = other.alias("o"), kept.select(*keys).alias("k")
        same = [left[k].eqNullSafe(right[k]) for k in keys]
        condition = same[0]
        for one in same[1:]:
            condition = condition & one
        merged = kept.unionByName(left.join(right, condition, "left_anti"))
    name = _publish(merged, root, number, partition_by)
    if [f for n, f in versions(spark, root) if n == number and not f.endswith(name)]:
        fs, marker = file_system(spark, f"{root}/{_MARKERS}/{name}")
        fs.delete(marker, False)
        raise ConcurrentRefresh(f"another job made version {number} of {root}")
    return number


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` snapshots, markers first; the number removed is returned."""
    old = versions(spark, root)[:-keep] if keep > 0 else []
    for _, folder in old:
        name = folder.rsplit("/", 1)[1]
        for path, deep in ((f"{root}/{_MARKERS}/{name}", False), (folder, True)):
            fs, known = file_system(spark, path)
            fs.delete(known, deep)
    return len(old)
