"""Score forecasts and rank models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tspanel.functions import FREQUENCIES
from tspanel.operators.panel import by_period


def accuracy(
    forecasts: DataFrame,
    keys: Sequence[str],
    actual: DataFrame | None = None,
    target: str | None = None,
) -> DataFrame:
    """``(keys, model, n, me, rmse, mae, mpe, mape, acf1)``.

    Actual values come from the ``actual`` column of the forecasts, or from the
    column ``target`` of a table joined on (key, period).
    """
    if actual is not None:
        known = actual.select(*keys, "period", F.col(target).alias("actual"))
        forecasts = forecasts.drop("actual").join(known, [*keys, "period"])
    by = [*keys, "model"]
    errors = (
        forecasts.select(*by, "period", "actual", (F.col("actual") - F.col("mean")).alias("e"))
        .filter("e is not null")
        .withColumn("off", F.col("e") - F.avg("e").over(Window.partitionBy(*by)))
        .withColumn("before", F.lag("off", 1).over(by_period(by)))
        .withColumn("share", F.try_divide(F.col("e"), F.col("actual")) * 100)
    )
    return errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("e").alias("me"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg(F.abs("e")).alias("mae"),
        F.avg("share").alias("mpe"),
        F.avg(F.abs("share")).alias("mape"),
        F.try_divide(
            F.sum(F.col("off") * F.col("before")), F.sum(F.col("off") * F.col("off"))
        ).alias("acf1"),
    )


def scaled_accuracy(
    scores: DataFrame, train: DataFrame, keys: Sequence[str], target: str, freq: str
) -> DataFrame:
    """Add ``mase`` and ``rmsse``: errors relative to the seasonal naive forecast on train."""
    step = F.col(target) - F.lag(target, FREQUENCIES[freq].seasons).over(by_period(keys))
    scale = (
        train.withColumn("step", step)
        .groupBy(*keys)
        .agg(F.avg(F.abs("step")).alias("s1"), F.sqrt(F.avg(F.col("step") ** 2)).alias("s2"))
    )
    return (
        scores.join(scale, list(keys), "left")
        .withColumn("mase", F.try_divide(F.col("mae"), F.col("s1")))
        .withColumn("rmsse", F.try_divide(F.col("rmse"), F.col("s2")))
        .drop("s1", "s2")
    )


def _ranked(df: DataFrame, by: Sequence[str], measure: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(measure).asc_nulls_last(), F.col("model"))
    return df.withColumn("rank", F.row_number().over(order))


def aicc_leaderboard(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, family, model, aicc, rank)``; ranks count within a family only."""
    return _ranked(fits.select(*keys, "family", "model", "aicc"), [*keys, "family"], "aicc")


def rmse_leaderboard(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, model, rmse, rank)`` over all models of a key."""
    return _ranked(scores.select(*keys, "model", "rmse"), keys, "rmse")


def winners(board: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first-ranked models as ``(keys, models)``, one row per key."""
    best = board.filter("rank = 1")
    return best.groupBy(*keys).agg(F.collect_set("model").alias("models"))
