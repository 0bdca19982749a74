"""All registered queries."""

from __future__ import annotations

import importlib

from .registry import CHECKS, QUERIES

for _module in ("telemetry", "samples", "matrix", "files", "detection", "streams"):
    importlib.import_module(f"{__package__}.queries_{_module}")

__all__ = ["CHECKS", "QUERIES"]
