"""Calendar periods. A period is a DATE: the first day of its month or quarter."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Month abbreviations used in `2006 Apr` labels.
MONTH_LABELS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


@dataclass(frozen=True)
class Frequency:
    name: str
    months: int

    @property
    def seasons(self) -> int:
        return 12 // self.months

    def add(self, day: dt.date, steps: int) -> dt.date:
        """The period ``steps`` after ``day`` (driver side, for a handful of dates)."""
        month = day.year * 12 + day.month - 1 + steps * self.months
        return dt.date(month // 12, month % 12 + 1, 1)

    def season(self, day: dt.date) -> int:
        return (day.month - 1) // self.months + 1


FREQUENCIES = {"month": Frequency("month", 1), "quarter": Frequency("quarter", 3)}


def period_trunc(date: Column, freq: str) -> Column:
    """First day of the period that contains ``date``; null stays null."""
    return F.trunc(date.cast("date"), freq)


def period_add(period: Column, steps: Column | int, freq: str) -> Column:
    return F.add_months(period, F.lit(steps) * FREQUENCIES[freq].months)


def period_index(period: Column, freq: str) -> Column:
    """Consecutive integers over periods, 0 for January 1970 or its quarter."""
    months = (F.year(period) - 1970) * 12 + F.month(period) - 1
    return F.floor(months / FREQUENCIES[freq].months).cast("int")


def season_of(period: Column, freq: str) -> Column:
    return F.quarter(period) if freq == "quarter" else F.month(period)


def parse_period_label(label: Column, freq: str) -> Column:
    """``2002 Q2`` or ``2006 Apr`` to its period; anything else gives null."""
    if freq == "quarter":
        pattern = r"^\s*(\d{4}) Q([1-4])\s*$"
        month = (F.regexp_extract(label, pattern, 2).try_cast("int") - 1) * 3 + 1
    else:
        pattern = rf"^\s*(\d{{4}}) ({'|'.join(MONTH_LABELS)})\s*$"
        names = F.array(*[F.lit(m) for m in MONTH_LABELS])
        month = F.array_position(names, F.regexp_extract(label, pattern, 2)).cast("int")
    year = F.regexp_extract(label, pattern, 1).try_cast("int")
    return F.when(label.rlike(pattern), F.make_date(year, month, F.lit(1)))


def format_period_label(period: Column, freq: str) -> Column:
    if freq == "quarter":
        return F.concat(F.year(period).cast("string"), F.lit(" Q"), F.quarter(period).cast("string"))
    names = F.array(*[F.lit(m) for m in MONTH_LABELS])
    return F.concat(F.year(period).cast("string"), F.lit(" "), F.element_at(names, F.month(period)))
