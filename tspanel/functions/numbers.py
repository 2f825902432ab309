"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def coerce_numeric(text: Column) -> Column:
    """Text to double; anything but a plain number (``.``, ``NaN``, ``Infinity``, ``1d``) is null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def percent_change(now: Column, before: Column) -> Column:
    """``(now / before - 1) * 100``; null where ``before`` is null or zero."""
    return (F.try_divide(now, before) - 1) * 100
