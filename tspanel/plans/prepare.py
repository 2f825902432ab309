"""From a raw long panel to a modelling table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tspanel.operators.panel import align_left, melt, resample_mean
from tspanel.operators.spec import Arima, Regression
from tspanel.operators.transform import add_events, pct_change


@dataclass(frozen=True)
class Source:
    """One input series: its code in the raw panel and its column name."""

    name: str
    code: str
    after_year: int | None = None


@dataclass(frozen=True)
class Study:
    """Everything that defines one analysis: inputs, calendar, models."""

    name: str
    freq: str
    target: str
    sources: tuple[Source, ...]
    derived: Mapping[str, str] = field(default_factory=dict)
    columns: tuple[str, ...] = ()
    events: Mapping[str, dt.date] = field(default_factory=dict)
    cutoff_year: int = 2021
    lag_max: int = 12
    regressions: tuple[Regression, ...] = ()
    regression_errors: tuple[Arima, ...] = ()
    arima: tuple[Arima, ...] = ()
    finalists: tuple[Regression | Arima, ...] = ()
    winner: Regression | Arima | None = None
    future: tuple[str, ...] = ()
    h: int = 4

    @property
    def predictors(self) -> list[str]:
        return [c for c in self.columns if c != self.target]


def prepare(raw: DataFrame, study: Study) -> DataFrame:
    """``(key, period, target, predictors, events)`` as percent changes.

    ``raw`` is ``(series, date, value)`` with codes as series names.
    """
    wanted = F.create_map(*[F.lit(v) for s in study.sources for v in (s.code, s.name)])
    kept = raw.filter(F.col("series").isin([s.code for s in study.sources]))
    for s in study.sources:
        if s.after_year is not None:
            early = F.col("date") < F.lit(dt.date(s.after_year + 1, 1, 1))
            kept = kept.filter(~((F.col("series") == s.code) & early))
    named = kept.withColumn("series", wanted[F.col("series")])
    periods = resample_mean(named, ["series"], "date", study.freq, ["value"])
    wide = align_left(periods, study.target, [s.name for s in study.sources])
    wide = wide.withColumns({n: F.expr(e) for n, e in study.derived.items()})
    wide = wide.select(F.lit(study.name).alias("key"), "period", *study.columns)
    changes = pct_change(wide, ["key"], study.columns, study.target)
    return add_events(changes, study.events)


def prepare_long(wide: DataFrame, study: Study) -> DataFrame:
    """The series columns as a long panel ``(key, series, period, value)``."""
    long = melt(wide.select("key", "period", *study.columns), ["key", "period"], study.columns)
    return long.select("key", "series", "period", "value")
