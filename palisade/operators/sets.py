"""Set operations on windows and events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

EVENT_KEY = ("computer", "timestamp", "event_id", "process_id")


def union_windows(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames whose columns differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unseen_events(events: DataFrame, seen: DataFrame, key: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Events whose key is not in ``seen``, each key once."""
    match = reduce(lambda a, b: a & b, (events[k].eqNullSafe(seen[k]) for k in key))
    return events.join(seen, match, "left_anti").dropDuplicates(list(key))
