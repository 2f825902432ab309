"""Row-wise and row-offset transforms of a wide panel."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tspanel.functions import FREQUENCIES, percent_change, season_of
from tspanel.operators.panel import by_period


def lagged(column: str, k: int, keys: Sequence[str]) -> Column:
    """The value ``k`` rows earlier (rows, not calendar steps)."""
    return F.lag(column, k).over(by_period(keys)) if k else F.col(column)


def pct_change(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str | None = None
) -> DataFrame:
    """Replace levels by percent changes over the previous row.

    With ``target``, rows whose target change is null are dropped; null predictors stay.
    """
    out = df.withColumns({c: percent_change(F.col(c), lagged(c, 1, keys)) for c in columns})
    return out.filter(F.col(target).isNotNull()) if target else out


def difference_weights(d: int, D: int, m: int) -> dict[int, int]:
    """Offsets and weights of ``d`` ordinary and ``D`` seasonal differences."""
    weights = {0: 1}
    for step in [1] * d + [m] * D:
        shifted = {o + step: -w for o, w in weights.items()}
        weights = {
            o: weights.get(o, 0) + shifted.get(o, 0) for o in sorted({*weights, *shifted})
        }
    return {o: w for o, w in weights.items() if w}


def differenced(column: str, k: int, d: int, D: int, m: int, keys: Sequence[str]) -> Column:
    """Differences of the ``k``-lagged column as one weighted sum of row offsets."""
    terms = [
        lagged(column, k + o, keys) * float(w) if w != 1 else lagged(column, k + o, keys)
        for o, w in difference_weights(d, D, m).items()
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def difference(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], d: int, D: int, freq: str
) -> DataFrame:
    """Replace columns by ordinary and seasonal differences; the first rows become null."""
    m = FREQUENCIES[freq].seasons
    return df.withColumns({c: differenced(c, 0, d, D, m, keys) for c in columns})


def add_lags(
    df: DataFrame, keys: Sequence[str], lags: Sequence[tuple[str, int]]
) -> DataFrame:
    """Add ``<column>_lag<k>`` for every (column, k) pair in one window pass."""
    return df.withColumns({f"{c}_lag{k}": lagged(c, k, keys) for c, k in lags})


def add_events(df: DataFrame, events: Mapping[str, dt.date]) -> DataFrame:
    """Add 0/1 pulses that are 1 in the named period only."""
    return df.withColumns(
        {n: F.when(F.col("period") == F.lit(d), 1.0).otherwise(0.0) for n, d in events.items()}
    )


def add_seasons(df: DataFrame, freq: str, intercept: bool = True) -> DataFrame:
    """Add seasonal dummies: all of them without an intercept, else all but the first."""
    season = season_of(F.col("period"), freq)
    first = 2 if intercept else 1
    return df.withColumns(
        {
            f"season_{j}": (season == j).cast("double")
            for j in range(first, FREQUENCIES[freq].seasons + 1)
        }
    )


def after_year(df: DataFrame, year: int, column: str = "period") -> DataFrame:
    """Rows with ``year(column) > year``, written as a range that reaches the scan."""
    return df.filter(F.col(column) >= F.lit(dt.date(year + 1, 1, 1)))


def until_year(df: DataFrame, year: int, column: str = "period") -> DataFrame:
    return df.filter(F.col(column) < F.lit(dt.date(year + 1, 1, 1)))


def add_split(df: DataFrame, year: int) -> DataFrame:
    """Mark rows up to ``year`` as ``train`` and later ones as ``test``."""
    in_train = F.col("period") < F.lit(dt.date(year + 1, 1, 1))
    return df.withColumn("split", F.when(in_train, "train").otherwise("test"))
