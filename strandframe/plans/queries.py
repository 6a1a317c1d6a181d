"""The driver queries of the core operators."""

from __future__ import annotations

from strandframe.plans import arrays, groups, records, scans, selection, units  # noqa: F401  they register their queries
from strandframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
