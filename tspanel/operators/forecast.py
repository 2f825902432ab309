"""Forecasts of regressions: a hold-out, or a future frame with given predictors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tspanel.operators.panel import by_period
from tspanel.operators.regression import predict
from tspanel.operators.spec import Regression

# Normal quantiles of the 80 % and 95 % intervals.
LEVELS = {80: 1.2815515655446004, 95: 1.959963984540054}


def with_intervals(df: DataFrame, sigma: Column) -> DataFrame:
    """Add ``sigma`` and the bounds ``lo80 .. hi95``."""
    out = df.withColumn("sigma", sigma)
    bounds = {}
    for level, z in LEVELS.items():
        bounds[f"lo{level}"] = F.col("mean") - z * F.col("sigma")
        bounds[f"hi{level}"] = F.col("mean") + z * F.col("sigma")
    return out.withColumns(bounds)


def extended(history: DataFrame, future: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History and future in one frame; ``h`` counts the future rows, 0 in the history.

    Lags of the first future rows therefore reach back into the history.
    """
    both = history.withColumn("ahead", F.lit(0)).unionByName(
        future.drop("h").withColumn("ahead", F.lit(1)), allowMissingColumns=True
    )
    running = by_period(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("h", F.sum("ahead").over(running).cast("int")).drop("ahead")


def forecast_regressions(
    history: DataFrame,
    future: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    models: Sequence[Regression],
    freq: str,
) -> DataFrame:
    """``(keys, model, period, h, actual, mean, sigma, lo80, hi80, lo95, hi95)``.

    ``future`` carries the predictors: a hold-out part of the data, or a frame from
    ``future_frame`` and ``future_predictors``.
    """
    frame = extended(history, future, keys)
    rows = predict(frame, fits, keys, models, freq, carry=["h"]).filter("h > 0")
    rows = with_intervals(rows, F.sqrt(F.col("sigma2") * (1 + F.col("leverage"))))
    return rows.drop("leverage", "sigma2")
