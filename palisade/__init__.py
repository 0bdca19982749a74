"""Behavioural security analytics on Spark: telemetry windows, detection, behaviour matrices, live streams."""
