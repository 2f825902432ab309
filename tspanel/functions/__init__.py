"""Column functions: calendar periods, numbers, information criteria."""

from .numbers import coerce_numeric, percent_change
from .periods import (
    FREQUENCIES,
    Frequency,
    format_period_label,
    parse_period_label,
    period_add,
    period_index,
    period_trunc,
    season_of,
)

__all__ = [
    "FREQUENCIES",
    "Frequency",
    "coerce_numeric",
    "format_period_label",
    "parse_period_label",
    "percent_change",
    "period_add",
    "period_index",
    "period_trunc",
    "season_of",
]
