"""Fit statistics as column expressions over n, rank and the error sum of squares."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def regression_criteria(n: Column, rank: Column, sse: Column) -> dict[str, Column]:
    """AIC, AICc and BIC in the scale used for linear regressions (variance ratio form)."""
    k = rank + 1
    aic = n * safe_ln(sse / n) + 2 * k
    return {
        "loglik": -n / 2 * (safe_ln(sse / n) + math.log(2 * math.pi) + 1),
        "aic": aic,
        "aicc": F.when(n - k - 1 > 0, aic + 2 * k * (k + 1) / (n - k - 1)),
        "bic": aic + k * (F.log(n) - 2),
    }


def likelihood_criteria(n: Column, k: Column, sse: Column) -> dict[str, Column]:
    """AIC, AICc and BIC from the Gaussian likelihood with ``k`` free parameters."""
    loglik = -n / 2 * (safe_ln(sse / n) + math.log(2 * math.pi) + 1)
    return {
        "loglik": loglik,
        "aic": -2 * loglik + 2 * k,
        "aicc": F.when(n - k - 1 > 0, -2 * loglik + 2 * k + 2 * k * (k + 1) / (n - k - 1)),
        "bic": -2 * loglik + k * F.log(n),
    }
