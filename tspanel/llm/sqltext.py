"""Text steps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str = SPACES) -> Column:
    """The pieces between separators."""
    return F.array_remove(F.split(text, separators), "")
