"""Design rows: one row per (key, model, period) with the target and its regressors.

The indicator regressors (intercept, seasons, pulses) depend on the calendar only.
Periods with equal indicators form a *cell*: one per season, plus one for each
period touched by a pulse. Rows carry their cell, and a small constant matrix turns
cells into indicator columns, so only lagged columns travel as data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tspanel.functions import FREQUENCIES, period_index, season_of
from tspanel.operators.spec import Lag, Regression
from tspanel.operators.transform import difference_weights, differenced


@dataclass(frozen=True)
class Terms:
    """Names of the regressors of one model, indicators first, and their cell matrix."""

    names: list[str]
    matrix: np.ndarray
    level: np.ndarray
    lags: list[str]
    order: list[int] = field(default_factory=list)
    constant: list[int] = field(default_factory=list)
    constant_value: float = 0.0

    @property
    def all(self) -> list[str]:
        return [*self.names, *self.lags]


def check_names(models: Sequence) -> None:
    names = [s.name for s in models]
    if len(set(names)) != len(names):
        raise ValueError(f"model names repeat: {sorted(names)}")


class Design:
    """The calendar cells, dense columns and terms shared by a list of models."""

    def __init__(self, models: Sequence[Regression], freq: str):
        check_names(models)
        self.models = list(models)
        self.freq = FREQUENCIES[freq]
        touched = {
            self.freq.add(pulse.period, offset)
            for s in models
            for pulse in s.pulses
            for offset in difference_weights(s.d, s.D, self.freq.seasons)
        }
        self.special: list[dt.date] = sorted(touched)
        self.terms = {s.name: self._terms(s) for s in models}
        self.width = max((len(s.lags) for s in models), default=0) + 1

    @property
    def referred(self) -> bool:
        """Whether a model has no constant, so that its statistics need a reference value."""
        return any(not t.constant for t in self.terms.values())

    @property
    def n_cells(self) -> int:
        return self.freq.seasons + len(self.special)

    def cell(self, period: Column) -> Column:
        usual = season_of(period, self.freq.name) - 1
        if not self.special:
            return usual.cast("int")
        places = F.array(*[F.lit(d) for d in self.special])
        place = F.array_position(places, period)
        return F.when(place > 0, place + self.freq.seasons - 1).otherwise(usual).cast("int")

    def _cell_periods(self) -> list[dt.date]:
        # any year far from the pulses represents the ordinary cells
        year = min((d.year for d in self.special), default=2000) - 100
        usual = [self.freq.add(dt.date(year, 1, 1), s) for s in range(self.freq.seasons)]
        return [*usual, *self.special]

    def _terms(self, s: Regression) -> Terms:
        m = self.freq.seasons
        weights = difference_weights(s.d, s.D, m)
        periods = self._cell_periods()
        names, columns, levels, constant, value = [], [], [], [], 0.0

        def add(name: str, test) -> None:
            names.append(name)
            levels.append([test(c) for c in periods])
            columns.append(
                [sum(w * test(self.freq.add(c, -o)) for o, w in weights.items()) for c in periods]
            )

        if s.intercept and s.d + s.D <= 1:
            # the mean of a once-differenced series is a trend of the level
            value = 1.0 if s.d + s.D == 0 or s.d else float(m)
            names.append("intercept" if s.d + s.D == 0 else "drift")
            columns.append([value] * len(periods))
            levels.append([1.0] * len(periods))
            constant = [0]
        if s.season:
            first = 2 if s.intercept else 1
            for j in range(first, m + 1):
                add(f"season_{j}", lambda c, j=j: float(self.freq.season(c) == j))
            if not s.intercept and s.d + s.D == 0:
                constant, value = list(range(m)), 1.0
        seasons = len(names)
        for pulse in s.pulses:
            add(pulse.name, lambda c, p=pulse: float(c == p.period))
        matrix, level = (
            np.array(v, dtype=float).reshape(len(names), len(periods)).T for v in (columns, levels)
        )
        lags = [lag.name for lag in s.lags]
        # aliased columns are the later ones in the order seasons, lags, pulses
        order = [
            *range(seasons),
            *range(len(names), len(names) + len(lags)),
            *range(seasons, len(names)),
        ]
        return Terms(names, matrix, level, lags, order, constant, value)

    def rows(
        self,
        frame: DataFrame,
        keys: Sequence[str],
        only: DataFrame | None = None,
        level: bool = False,
        carry: Sequence[str] = (),
        refer: bool = False,
    ) -> DataFrame:
        """``(keys, period, carry, cell, model, v0 .. v<width-1>)``; v0 is the target.

        ``only`` holds ``(keys, models)``: per key, the model names to keep. Unused
        columns are 0. One window pass serves all models; rows are copied per model
        inside the same stage. ``level`` ignores the differencing of the models. ``refer``
        adds ``r0 .. r<width-1>``, the least value of each column per key.
        """

        def columns_of(s: Regression) -> list[tuple[str, int, int, int]]:
            d, D = (0, 0) if level else (s.d, s.D)
            return [(g.column, g.k, d, D) for g in (Lag(s.target), *s.lags)]

        # every distinct (column, lag, d, D) is one window expression
        wanted = dict.fromkeys(c for s in self.models for c in columns_of(s))
        dense = {c: differenced(*c, self.freq.seasons, keys) for c in wanted}
        ids = {c: f"x{i}" for i, c in enumerate(dense)}
        kept = ["period", *carry]
        wide = frame.select(
            *keys,
            *kept,
            self.cell(F.col("period")).alias("cell"),
            *[expr.alias(ids[c]) for c, expr in dense.items()],
        )
        if refer:
            whole = Window.partitionBy(*keys)
            wide = wide.withColumns({f"{x}_least": F.min(x).over(whole).cast("double") for x in ids.values()})
        structs = []
        for s in self.models:
            values = [F.col(ids[c]) for c in columns_of(s)]
            values += [F.lit(0.0)] * (self.width - len(values))
            least = []
            if refer:
                least = [F.col(f"{ids[c]}_least") for c in columns_of(s)]
                least += [F.lit(0.0)] * (self.width - len(least))
            structs.append(
                F.struct(
                    F.lit(s.name).alias("model"),
                    *[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)],
                    *[v.alias(f"r{i}") for i, v in enumerate(least)],
                )
            )
        if only is not None:
            wide = wide.join(only, list(keys))
            kept = [*kept, "models"]
        long = wide.select(*keys, *kept, "cell", F.inline(F.array(*structs)))
        if only is not None:
            long = long.filter(F.array_contains("models", F.col("model"))).drop("models")
        return long

    def level(self, fit: Column) -> Column:
        """The regression mean of a design row, from the cell profile of its fit.

        Plain sums over the dense columns: no arrays are built per row.
        """
        index = period_index(F.col("period"), self.freq.name)
        total = F.element_at(fit["base"], F.col("cell") + 1) + fit["trend"] * index
        for i in range(self.width - 1):
            total = total + F.col(f"v{i + 1}") * fit["slope"][i]
        return total

    def leverage(self, fit: Column) -> Column:
        """``x' (X'X)^-1 x`` of a design row, from the cell profile of its fit."""
        k = self.width - 1
        total = F.element_at(fit["base_spread"], F.col("cell") + 1)
        for i in range(k):
            v = F.col(f"v{i + 1}")
            total = total + 2 * v * F.element_at(fit["cross_spread"], F.col("cell") * k + i + 1)
            for j in range(k):
                total = total + v * F.col(f"v{j + 1}") * fit["slope_spread"][i * k + j]
        return total

    def complete(self) -> Column:
        ok = F.lit(True)
        for i in range(self.width):
            ok = ok & F.col(f"v{i}").isNotNull()
        return ok

    def by_model(self, values: dict[str, Column]) -> Column:
        choice = None
        for name, value in values.items():
            is_model = F.col("model") == name
            choice = F.when(is_model, value) if choice is None else choice.when(is_model, value)
        return choice
