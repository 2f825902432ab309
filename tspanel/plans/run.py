"""A whole study: prepare, describe, compare, forecast, with the tables stored."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tspanel.operators.describe import (
    autocorrelation,
    correlation_table,
    cross_correlation,
    kpss,
    seasonal_subseries,
    stl,
)
from tspanel.operators.tables import history_with_forecast
from tspanel.operators.transform import until_year
from tspanel.plans.compare import (
    fit_models,
    forecast_two_stage,
    holdout_scores,
    leaderboard,
)
from tspanel.plans.prepare import Study, prepare, prepare_long
from tspanel.session import stage

KEYS = ["key"]


def describe(wide: DataFrame, study: Study) -> dict[str, DataFrame]:
    """Stationarity, correlation, seasons and decomposition of a prepared table."""
    long = prepare_long(wide, study)
    by = ["key", "series"]
    ccf = cross_correlation(
        wide, KEYS, study.target, study.predictors, study.lag_max, study.freq
    )
    return {
        "kpss": kpss(long, by),
        "acf": autocorrelation(long, by, "value", 12, study.freq),
        "ccf": correlation_table(ccf, KEYS, study.predictors, study.lag_max),
        "subseries": seasonal_subseries(long, by, study.freq),
        "stl": stl(wide, KEYS, study.freq, study.target),
    }


def compare(wide: DataFrame, study: Study) -> dict[str, DataFrame]:
    """AICc ranks per family on the training years, hold-out scores of the finalists."""
    train = until_year(wide, study.cutoff_year)
    models = [*study.regressions, *study.regression_errors, *study.arima]
    fits = fit_models(train, KEYS, models, study.freq)
    return {
        "aicc": leaderboard(fits, KEYS),
        "holdout": holdout_scores(wide, KEYS, study.finalists, study.freq, study.cutoff_year),
    }


def forecast(wide: DataFrame, study: Study) -> DataFrame:
    """History and forecast of the winning model, its predictors forecast first."""
    fits = fit_models(wide, KEYS, [study.winner], study.freq)
    ahead = forecast_two_stage(
        wide, KEYS, [study.winner], fits, study.freq, study.h, list(study.future),
        list(study.events),
    )
    return history_with_forecast(wide, ahead, KEYS, study.target)


def run_study(raw: DataFrame, study: Study) -> dict[str, DataFrame]:
    """All tables of a study from a raw panel ``(series, date, value)``."""
    wide = stage(prepare(raw, study), KEYS)
    return {
        "wide": wide,
        "long": prepare_long(wide, study),
        **describe(wide, study),
        **compare(wide, study),
        "forecast": forecast(wide, study),
    }
