"""All registered queries."""

from __future__ import annotations

from tidewell.plans import alerts, analytics, ingest, lifecycle, monitoring, search, streams
from tidewell.plans.registry import ORACLES, QUERIES

AREAS = [analytics, ingest, search, lifecycle, alerts, monitoring, streams]

__all__ = ["AREAS", "ORACLES", "QUERIES"]
