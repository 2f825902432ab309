"""Queries over the test tables, each with SQL that gives the same result."""

from . import describe, forecasts, models, prepare
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "describe", "forecasts", "models", "prepare"]
