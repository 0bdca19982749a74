"""Descendants of a process, as intents only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import durable

# Process names that are never proposed for termination.
PROTECTED = ("lsass", "csrss", "smss", "wininit", "winlogon", "services", "system", "svchost", "explorer",
             "spoolsv", "dwm")


def _by_levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Breadth-first depths for processes that may have several parents: one job a level, each new process once, which also ends cycles."""
    level = durable(roots.select("pid").distinct().withColumn("depth", F.lit(0)))
    reached, depth = level, 0
    while True:
        depth += 1
        children = edges.join(level.select(F.col("pid").alias("parent_pid")), "parent_pid").select("pid").distinct()
        level = durable(children.join(reached, "pid", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return reached
        reached = reached.unionByName(level)


def _by_doubling(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Depths for processes with one parent each: every process looks at its ancestor 1, 2, 4, ... steps up until a root is met.

    The number of jobs grows with the logarithm of the depth. What still climbs after more steps than there are processes goes round in a cycle.
    """
    top = roots.select("pid").distinct()
    marked = top.select(F.col("pid").alias("up"), F.lit(True).alias("met"))
    below = edges.join(top, "pid", "left_anti").select("pid", F.col("parent_pid").alias("up"), F.lit(1).cast("long").alias("steps"))
    state = durable(below.join(marked, "up", "left").select("pid", "up", "steps", F.coalesce("met", F.lit(False)).alias("met")))
    limit, climbed = state.count(), 1
    while climbed <= limit:
        ahead = state.select(F.col("pid").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("met").alias("then"))
        moved = state.filter("not met").join(ahead, "up").select("pid", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("then").alias("met"))
        state = durable(state.filter("met").unionByName(moved))
        climbed *= 2
        if state.filter("not met").isEmpty():
            break
    return top.withColumn("depth", F.lit(0)).unionByName(state.filter("met").select("pid", F.col("steps").cast("int").alias("depth")))


def process_tree_closure(processes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every process below the roots (column ``pid``) with its least depth and the intent for it.

    ``processes`` has ``pid, parent_pid, name``. Trees of any depth are followed to their end.
    """
    edges = durable(processes.filter(F.col("parent_pid").isNotNull()).select("pid", "parent_pid").distinct())
    several = edges.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    reached = _by_doubling(edges, roots) if several.isEmpty() else _by_levels(edges, roots)
    names = processes.groupBy("pid").agg(F.min("name").alias("name"))
    protected = F.lower(F.coalesce("name", F.lit("unknown"))).isin(*PROTECTED)
    return (reached.join(names, "pid", "left")
            .withColumn("intent", F.when(protected, "REFUSE_PROTECTED").otherwise("WOULD_TERMINATE")))
