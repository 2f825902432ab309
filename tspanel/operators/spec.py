"""Model specifications as plain values."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

Range = int | tuple[int, int]

# Default search ranges of the automatic ARIMA orders, and the limit on their sum.
DEFAULT_RANGES = {"p": (0, 5), "q": (0, 5), "P": (0, 2), "Q": (0, 2)}
MAX_TOTAL_ORDER = 6


@dataclass(frozen=True)
class Lag:
    """A regressor: ``column`` as it was ``k`` rows earlier."""

    column: str
    k: int = 0

    @property
    def name(self) -> str:
        return f"{self.column}_lag{self.k}"


@dataclass(frozen=True)
class Pulse:
    """A regressor that is 1 in one period and 0 elsewhere."""

    name: str
    period: dt.date


@dataclass(frozen=True)
class Regression:
    """A linear regression on seasons, lagged columns and pulses.

    ``d`` and ``D`` difference both sides; ``family`` is the group the model is
    ranked in.
    """

    name: str
    target: str
    season: bool = False
    intercept: bool = True
    lags: tuple[Lag, ...] = ()
    pulses: tuple[Pulse, ...] = ()
    family: str = "tslm"
    d: int = 0
    D: int = 0


@dataclass(frozen=True)
class Arima:
    """A regression whose errors follow an ARIMA process.

    Orders are a number, an inclusive range, or None for the default range. ``d``
    and ``D`` are a number, or None to choose them per key by tests. ``intercept`` None tries the
    model with and without a constant (a drift after one difference). Seasonal polynomials multiply
    with the ordinary ones; with ``multiplicative`` False their lags add up. ``max_total`` bounds the
    sum of the orders where one of them is left to the default range.
    """

    name: str
    target: str
    p: Range | None = None
    d: int | None = None
    q: Range | None = None
    P: Range | None = None
    D: int | None = None
    Q: Range | None = None
    season: bool = False
    intercept: bool | None = True
    lags: tuple[Lag, ...] = ()
    pulses: tuple[Pulse, ...] = ()
    family: str = "arima"
    multiplicative: bool = True
    max_total: int = MAX_TOTAL_ORDER

    def constants(self) -> list[bool]:
        """The choices for the constant, the one with it first."""
        return [True, False] if self.intercept is None else [self.intercept]

    def mean_model(self, d: int, D: int, constant: bool | None = None) -> Regression:
        constant = self.constants()[0] if constant is None else constant
        return Regression(
            self.name, self.target, self.season, constant, self.lags, self.pulses, self.family, d, D
        )

    def orders(self) -> list[tuple[int, int, int, int]]:
        """All (p, q, P, Q) of the ranges. The limit on their sum holds where at least
        one range is the default, as those define the automatic search."""

        def bounds(name: str) -> tuple[int, int]:
            value = getattr(self, name)
            value = DEFAULT_RANGES[name] if value is None else value
            return (value, value) if isinstance(value, int) else value

        automatic = any(getattr(self, o) is None for o in "pqPQ")
        spans = [range(lo, hi + 1) for lo, hi in map(bounds, "pqPQ")]
        grid = [(p, q, P, Q) for p in spans[0] for q in spans[1] for P in spans[2] for Q in spans[3]]
        return [o for o in grid if not automatic or sum(o) <= self.max_total]


def as_arima(model: Regression) -> Arima:
    """A plain regression expressed with all ARIMA orders zero."""
    return Arima(
        model.name, model.target, 0, model.d, 0, 0, model.D, 0, model.season,
        model.intercept, model.lags, model.pulses, model.family,
    )

