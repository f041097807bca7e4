"""Registered queries over the given tables, with their SQL checks."""

from tidewatch.plans import (  # noqa: F401  (importing registers the queries)
    corpora, dashboard, models, scans, statistics, streams, texts,
)
from tidewatch.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
