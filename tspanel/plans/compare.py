"""Compare models per key, choose, refit and forecast.

Each plan stores its reduced inputs once (``stage``), then composes operators; the
choice differs from key to key and stays in a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tspanel.functions import period_add, period_index
from tspanel.operators.arima import fit_arima, forecast_arima
from tspanel.operators.forecast import forecast_regressions
from tspanel.operators.panel import future_frame, future_predictors, melt
from tspanel.operators.regression import fit_regressions
from tspanel.operators.score import accuracy, aicc_leaderboard, rmse_leaderboard, winners
from tspanel.operators.spec import Arima, Regression
from tspanel.operators.transform import after_year, until_year
from tspanel.session import stage

Model = Regression | Arima


def _split(models: Sequence[Model]) -> tuple[list[Regression], list[Arima]]:
    return (
        [m for m in models if isinstance(m, Regression)],
        [m for m in models if isinstance(m, Arima)],
    )


def fit_models(
    train: DataFrame,
    keys: Sequence[str],
    models: Sequence[Model],
    freq: str,
    only: DataFrame | None = None,
    **arima_options,
) -> list[DataFrame]:
    """Fits of the regressions and of the ARIMA models, in this order; either may be absent."""
    plain, errors = _split(models)
    fits = []
    if plain:
        fits.append(stage(fit_regressions(train, keys, plain, freq, only), keys))
    if errors:
        fits.append(fit_arima(train, keys, errors, freq, only=only, **arima_options))
    return fits


def forecast_models(
    history: DataFrame,
    future: DataFrame,
    fits: Sequence[DataFrame],
    keys: Sequence[str],
    models: Sequence[Model],
    freq: str,
) -> DataFrame:
    """Forecasts of all fitted models in one table."""
    plain, errors = _split(models)
    parts = list(fits)
    out = []
    if plain:
        out.append(forecast_regressions(history, future, parts.pop(0), keys, plain, freq))
    if errors:
        out.append(forecast_arima(history, future, parts.pop(0), keys, errors, freq))
    total = out[0]
    for part in out[1:]:
        total = total.unionByName(part)
    return total


def leaderboard(fits: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """AICc ranks within each family over all fits."""
    columns = [*keys, "model", "family", "aicc"]
    table = fits[0].select(*columns)
    for part in fits[1:]:
        table = table.unionByName(part.select(*columns))
    return aicc_leaderboard(table, keys)


def holdout_scores(
    frame: DataFrame,
    keys: Sequence[str],
    models: Sequence[Model],
    freq: str,
    cutoff_year: int,
    best_per_family: bool = False,
    **arima_options,
) -> DataFrame:
    """Fit on the years up to the cut, forecast the rest with its own predictors, score.

    With ``best_per_family`` only the model with the least AICc of each family and key
    goes on to the hold-out.
    """
    train, test = until_year(frame, cutoff_year), after_year(frame, cutoff_year)
    fits = fit_models(train, keys, models, freq, **arima_options)
    if best_per_family:
        best = stage(leaderboard(fits, keys).filter("rank = 1").select(*keys, "model"), keys)
        fits = [f.join(best, [*keys, "model"], "left_semi") for f in fits]
    return accuracy(forecast_models(train, test, fits, keys, models, freq), keys)


def select_and_refit(
    frame: DataFrame,
    keys: Sequence[str],
    models: Sequence[Model],
    freq: str,
    cutoff_year: int,
    best_per_family: bool = False,
    **arima_options,
) -> tuple[DataFrame, list[DataFrame]]:
    """The hold-out ranking, and the winner of each key fitted on all its data."""
    frame = stage(frame, keys)
    scores = holdout_scores(
        frame, keys, models, freq, cutoff_year, best_per_family, **arima_options
    )
    board = stage(rmse_leaderboard(scores, keys), keys)
    fits = fit_models(frame, keys, models, freq, winners(board, keys), **arima_options)
    return board, fits


def forecast_predictors(
    history: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    freq: str,
    h: int,
    spec: Arima | None = None,
    **arima_options,
) -> DataFrame:
    """``(keys, series, period, h, mean)``: every predictor forecast by its own model.

    Predictors become keys of one long panel, so all of them are fitted in one job.
    The default model is an automatic ARIMA.
    """
    spec = spec or Arima("predictor", "value")
    by = [*keys, "series"]
    long = melt(history.select(*keys, "period", *names), [*keys, "period"], names)
    long = stage(long.filter("value is not null"), by)
    fits = fit_arima(long, by, [spec], freq, **arima_options)
    # a predictor that ends early is carried over its missing periods as well
    target_end = history.groupBy(*keys).agg(F.max("period").alias("end"))
    own_end = long.groupBy(*by).agg(F.max("period").alias("last"))
    missing = period_index(F.col("end"), freq) - period_index(F.col("last"), freq)
    ahead = (
        own_end.join(target_end, list(keys))
        .select(*by, "last", F.explode(F.sequence(F.lit(1), missing + h)).alias("step"))
        .select(*by, period_add(F.col("last"), F.col("step"), freq).alias("period"))
    )
    forecasts = forecast_arima(long, ahead, fits, by, [spec], freq)
    return forecasts.select(*by, "period", "h", "mean", "sigma")


def forecast_two_stage(
    history: DataFrame,
    keys: Sequence[str],
    models: Sequence[Model],
    fits: Sequence[DataFrame],
    freq: str,
    h: int,
    predictors: Sequence[str],
    zeros: Sequence[str] = (),
    predictor_spec: Arima | None = None,
    **arima_options,
) -> DataFrame:
    """Forecast the predictors first, then the target from them, ``h`` periods ahead."""
    future = future_frame(history, keys, freq, h)
    if predictors:
        ahead = forecast_predictors(
            history, keys, predictors, freq, h, predictor_spec, **arima_options
        )
        future = future_predictors(future, ahead, keys, predictors, zeros)
    return forecast_models(history, stage(future, keys), fits, keys, models, freq)
