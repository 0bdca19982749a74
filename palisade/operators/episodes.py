"""Sequences of scores and events per host: silence gaps and escalation episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import seconds_between
from ..schemas import ALERT_THRESHOLD, RESET_THRESHOLD, SILENCE_SECONDS, WARNING_THRESHOLD
from .ordering import running_total, trailing


def silence_gaps(events: DataFrame, group: Sequence[str] = ("computer",), time: str = "timestamp",
                 ties: Sequence[str] = (), threshold: float = SILENCE_SECONDS) -> DataFrame:
    """Seconds since the host's previous event and whether the sensor was silent in between."""
    def previous(w):
        return {"previous_time": F.when(F.count(time).over(w) > 1, F.min(time).over(w))}
    spaced = trailing(events.filter(F.col(time).isNotNull()), group, (time, *ties), 2, previous)
    gap = seconds_between(F.col(time), F.col("previous_time"))
    return (spaced.withColumn("gap_seconds", gap)
            .withColumn("status", F.when(gap > threshold, "SENSOR_SILENCED").otherwise("HEALTHY")))


def decisive(score: Column) -> Column:
    """Scores in between the reset and the warning level change nothing."""
    return (score < RESET_THRESHOLD) | (score >= WARNING_THRESHOLD)


def episode_firsts(scored: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each ``episode`` (number of resets so far) of a group the first warning ``w``, the first critical score ``c`` and ``peak_risk``.

    A stretch of scores matters to what follows only by its resets and by the firsts after the last one; resets add up and firsts are
    minima, so stretches compose in any grouping and a hot group spreads over tasks. Only scores that decide are numbered.
    """
    score = F.col("risk_score")
    marked = (scored.filter(decisive(score)).select(*group, *order, "risk_score")
              .withColumn("_reset", F.when(score < RESET_THRESHOLD, 1).otherwise(0)))
    runs = running_total(marked, group, (*order, "risk_score"), "_reset", "episode")
    spot = F.struct(*(F.col(o) for o in order), score.alias("risk_score"))
    warning = F.when((score >= WARNING_THRESHOLD) & (score < ALERT_THRESHOLD), spot)
    critical = F.when(score >= ALERT_THRESHOLD, spot)
    return runs.groupBy(*group, "episode").agg(F.min(warning).alias("w"), F.min(critical).alias("c"), F.max(score).alias("peak_risk"))


def escalation_episodes(scored: DataFrame, group: Sequence[str] = ("computer",),
                        order: Sequence[str] = ("window_start", "process_key")) -> DataFrame:
    """Incidents raised by a two-level hysteresis over each host's scores.

    A score under the reset level ends an episode. Within one episode the first score of the warning
    band and the first critical score matter: a warning that comes first is upgraded by the critical
    score; a critical score that comes first stands alone and a later warning opens a second incident.
    """
    firsts = episode_firsts(scored, group, order).filter(F.col("w").isNotNull() | F.col("c").isNotNull())
    w, c = F.col("w"), F.col("c")
    upgraded = w.isNotNull() & c.isNotNull() & (w < c)
    time = order[0]

    def raised(at, by, status):
        return F.struct(at[time].alias("opened_at"), by["risk_score"].alias("risk_score"),
                        F.lit(status).alias("status"))
    incidents = F.array_compact(F.array(
        F.when(upgraded, raised(w, c, "ACTIVE")),
        F.when(c.isNotNull() & ~F.coalesce(upgraded, F.lit(False)), raised(c, c, "ACTIVE")),
        F.when(w.isNotNull() & ~F.coalesce(upgraded, F.lit(False)), raised(w, w, "MONITORING"))))
    return (firsts.withColumn("i", F.explode(incidents))
            .select(*group, "episode", "i.opened_at", "i.risk_score", "i.status", "peak_risk"))
