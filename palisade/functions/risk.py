"""Score helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import ALERT_THRESHOLD, WARNING_THRESHOLD

# Techniques that are never scored.
BENIGN_TECHNIQUES = ("benign", "unknown", "monitoring", "live-monitoring")


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def risk_band(score: Column) -> Column:
    return (F.when(score >= ALERT_THRESHOLD, "crimson")
            .when(score >= WARNING_THRESHOLD, "amber").otherwise("mint"))


def benign_technique(technique: Column) -> Column:
    """Benign, unknown and monitoring sources; a missing technique counts as unknown."""
    return F.lower(F.coalesce(technique, F.lit("unknown"))).isin(*BENIGN_TECHNIQUES)


def low_activity(events: Column, files: Column, registry: Column) -> Column:
    """Idle windows that are not worth scoring; missing counts are 0."""
    def n(c: Column) -> Column:
        return F.coalesce(c, F.lit(0))
    return (n(events) < 15) & (n(files) < 3) & (n(registry) < 3)
