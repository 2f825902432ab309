"""The loess steps of the seasonal-trend decomposition, for a batch of equally long series.

A missing value has the weight 0 in every local fit, and the fits are evaluated at its place all the same.
"""

from __future__ import annotations

import numpy as np

# Windows and degrees of the decomposition (non-robust, two passes).
SEASON_WINDOW = 11
SEASON_DEGREE = 0
TREND_DEGREE = 1
LOWPASS_DEGREE = 1
PASSES = 2


def next_odd(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def loess_weights(n: int, at: np.ndarray, window: int, degree: int):
    """First index, weights and offsets of the local fit at each position of ``at``, and its degree.

    A fit uses ``min(window, n)`` neighbours, so the weights are a narrow band and
    memory grows with n, not with its square.
    """
    q = min(window, n)
    left = np.clip(np.ceil(at - q / 2), 0, n - q).astype(int)
    x = left[:, None] + np.arange(q)
    reach = np.maximum(at - left, left + q - 1 - at) + max(0, (window - n) // 2)
    ratio = np.abs(x - at[:, None]) / np.maximum(reach, 1e-12)[:, None]
    w = np.where(ratio < 0.999, (1 - np.minimum(ratio, 1) ** 3) ** 3, 0.0)
    w = np.where(ratio <= 0.001, 1.0, w)
    return x, w, at, n, degree


def smooth(y: np.ndarray, weights, known: np.ndarray | None = None) -> np.ndarray:
    """The local fits of all rows; not a number where no known value is near.

    ``known`` tells the values that count, per row; without it all do, and all rows share the weights.
    """
    x, w, at, n, degree = weights
    w = w[None] if known is None else w * known[:, x]
    total = w.sum(axis=2, keepdims=True)
    w = np.divide(w, total, out=np.full(w.shape, np.nan), where=total > 0)
    if degree:
        centre = (w * x).sum(axis=2)
        off = x - centre[:, :, None]
        spread = (w * off**2).sum(axis=2)
        usable = np.sqrt(np.nan_to_num(spread)) > 0.001 * max(n - 1, 1)
        slope = np.where(usable, (at - centre) / np.where(usable, spread, 1), 0)
        w = w * (1 + slope[:, :, None] * off)
    return (w * y[:, x]).sum(axis=2)


def moving_average(y: np.ndarray, width: int) -> np.ndarray:
    size = y.shape[1] - width + 1
    return sum(y[:, i : i + size] for i in range(width)) / width


class Plan:
    """The weights for series of length ``n`` with ``m`` seasons."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m
        points = np.arange(n, dtype=float)
        trend_window = next_odd(1.5 * m / (1 - 1.5 / SEASON_WINDOW))
        self.trend = loess_weights(n, points, trend_window, TREND_DEGREE)
        self.lowpass = loess_weights(n, points, next_odd(m), LOWPASS_DEGREE)
        sizes = {len(range(phase, n, m)) for phase in range(m)}
        self.cycle = {
            k: loess_weights(k, np.arange(-1, k + 1, dtype=float), SEASON_WINDOW, SEASON_DEGREE)
            for k in sizes
        }

    def decompose(self, y: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trend and season of the rows of ``y``; not numbers where known values are too sparse."""
        n, m = self.n, self.m
        mask = None if known.all() else known.astype(float)
        trend = season = np.zeros_like(y)
        for _ in range(PASSES):
            detrended = np.where(known, y - trend, 0.0)
            cycles = np.zeros((len(y), n + 2 * m))
            for phase in range(m):
                part = detrended[:, phase::m]
                cycles[:, phase::m] = smooth(part, self.cycle[part.shape[1]], None if mask is None else mask[:, phase::m])
            low = moving_average(moving_average(moving_average(cycles, m), m), 3)
            season = cycles[:, m : m + n] - smooth(low, self.lowpass)
            trend = smooth(np.where(known, y - season, 0.0), self.trend, mask)
        return trend, season
