"""Registered queries: every operator applied to the driver's tables, with the SQL that it must equal."""

from __future__ import annotations

from .base import ORACLES, QUERIES
from . import evaluation, graph, lookup, resolution, scalars, selection, upkeep  # noqa: F401  (they register themselves)

__all__ = ["ORACLES", "QUERIES"]
