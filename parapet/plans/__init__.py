"""Registered queries of the building-height operators."""

from . import aggregates, chips, filters, joins, polygons, rasters, scalar_plans, scans, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
