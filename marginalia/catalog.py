"""Registered queries of the library and the SQL that must return the same rows."""

from __future__ import annotations

from marginalia.plans import details, papers, reports, requests, streams, views  # noqa: F401
from marginalia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
