"""The tables behind the usual plots and printouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tspanel.operators.describe import autocorrelation


def residual_acf(residuals: DataFrame, keys: Sequence[str], lag_max: int = 12) -> DataFrame:
    return autocorrelation(residuals, [*keys, "model"], "residual", lag_max)


def residual_histogram(residuals: DataFrame, keys: Sequence[str], bins: int = 30) -> DataFrame:
    """``(keys, model, bin, lower, upper, n)``: equal bins from the least to the greatest.

    Empty bins are left out; bins are closed on the left, the last on both sides.
    """
    by = [*keys, "model"]
    whole = Window.partitionBy(*by)
    rows = residuals.select(
        *by,
        "residual",
        F.min("residual").over(whole).alias("least"),
        F.max("residual").over(whole).alias("most"),
    ).withColumn("width", (F.col("most") - F.col("least")) / bins)
    place = F.floor(F.try_divide(F.col("residual") - F.col("least"), F.col("width")))
    bin_ = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)) + 1
    counts = rows.groupBy(*by, bin_.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("least").alias("least"),
        F.first("width").alias("width"),
    )
    return counts.select(
        *by,
        "bin",
        (F.col("least") + (F.col("bin") - 1) * F.col("width")).alias("lower"),
        (F.col("least") + F.col("bin") * F.col("width")).alias("upper"),
        "n",
    )


def history_with_forecast(
    history: DataFrame, forecasts: DataFrame, keys: Sequence[str], target: str
) -> DataFrame:
    """``(keys, kind, model, period, value, lo80, hi80, lo95, hi95)`` in one table."""
    bounds = ["lo80", "hi80", "lo95", "hi95"]
    past = history.select(
        *keys,
        F.lit("history").alias("kind"),
        F.lit(None).cast("string").alias("model"),
        "period",
        F.col(target).alias("value"),
        *[F.lit(None).cast("double").alias(b) for b in bounds],
    )
    ahead = forecasts.select(
        *keys, F.lit("forecast").alias("kind"), "model", "period", F.col("mean").alias("value"), *bounds
    )
    return past.unionByName(ahead)


def train_and_test(frame: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """The table behind a train/test plot: ``(keys, kind, period, value)``."""
    return frame.select(*keys, F.col("split").alias("kind"), "period", F.col(target).alias("value"))


def model_orders(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, model, orders)``, sorted by nothing: one row per fitted model."""
    return fits.select(*keys, "model", "orders")
