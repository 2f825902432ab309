"""Describe series: stationarity, correlation, seasonality, decomposition."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tspanel.functions import FREQUENCIES, period_index, season_of
from tspanel.operators.algebra import pieces, slices
from tspanel.operators.panel import by_period, fill_gaps, widen
from tspanel.operators.stl import Plan

# Critical values of the level-stationarity test and their p-values.
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))

# The test window is trunc(4 (n/100)^(1/4)). 23 covers n < 129600 rows, more than
# the months between the years 1 and 9999, the widest range of a DATE; more are an error.
KPSS_MAX_WINDOW = 23
KPSS_MAX_ROWS = 129_600


def _interpolated_p(stat: Column) -> Column:
    p = F.when(stat <= KPSS_TABLE[0][0], KPSS_TABLE[0][1])
    for (x0, p0), (x1, p1) in zip(KPSS_TABLE, KPSS_TABLE[1:]):
        p = p.when(stat <= x1, p0 + (stat - x0) * ((p1 - p0) / (x1 - x0)))
    return F.when(stat.isNotNull(), p.otherwise(KPSS_TABLE[-1][1]))


def kpss(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Level-stationarity test per key: ``(keys, n, kpss_stat, kpss_p)``.

    Partial sums and lagged products come from one window pass over the key, the
    statistic from one aggregation on the same partitioning.
    """
    whole = Window.partitionBy(*keys)
    order = by_period(keys)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    window = F.floor(4 * F.pow(F.col("n") / 100, 0.25))
    centred = (
        df.filter(F.col(value).isNotNull())
        .select(*keys, "period", F.col(value).alias("y"))
        .withColumns({"n": F.count("y").over(whole), "mean": F.avg("y").over(whole)})
        .withColumn("e", F.col("y") - F.col("mean"))
        .withColumn("l", window)
        .withColumns(
            {
                "s": F.sum("e").over(running),
                **{f"e{k}": F.lag("e", k).over(order) for k in range(1, KPSS_MAX_WINDOW + 1)},
            }
        )
    )
    weighted = F.lit(0.0)
    for k in range(1, KPSS_MAX_WINDOW + 1):
        weight = F.greatest(F.lit(0.0), 1 - k / (F.col("l") + 1))
        weighted = weighted + weight * F.coalesce(F.col(f"e{k}"), F.lit(0.0))
    sums = centred.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum(F.col("s") * F.col("s")).alias("ss"),
        F.sum(F.col("e") * F.col("e")).alias("ee"),
        F.sum(F.col("e") * weighted).alias("ew"),
    )
    # a longer series than the calendar has months would lose its outer lags
    too_long = F.raise_error(F.concat(F.lit("kpss: too many rows for one key: "), F.col("n")))
    sums = sums.withColumn("ew", F.when(F.col("n") < KPSS_MAX_ROWS, F.col("ew")).otherwise(too_long.cast("double")))
    variance = (F.col("ee") + 2 * F.col("ew")) / F.col("n")
    stat = F.try_divide(F.col("ss"), F.col("n") * F.col("n") * variance)
    # a constant series has no scale to compare with
    stat = F.when(F.col("ee") > 0, stat)
    return sums.select(*keys, "n", stat.alias("kpss_stat")).withColumn(
        "kpss_p", _interpolated_p(F.col("kpss_stat"))
    )


def _runs(
    df: DataFrame, keys: Sequence[str], complete: Mapping[str, Column], freq: str | None
) -> DataFrame:
    """Add, per name, ``<name>_at``: the place from 1 of a row in the key's longest complete stretch.

    Null outside that stretch. Ties go to the first stretch. All names share one
    partitioning and sort by the key.
    """
    order = by_period(keys)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    gap = F.lit(False)
    if freq:
        index = period_index(F.col("period"), freq)
        gap = F.coalesce(index - F.lag(index, 1).over(order) > 1, F.lit(False))
    df = df.withColumns({"_gap": gap, **{f"{c}_ok": ok for c, ok in complete.items()}})
    broken = {c: ~F.col(f"{c}_ok") | F.col("_gap") for c in complete}
    df = df.withColumns(
        {f"{c}_run": F.sum(broken[c].cast("int")).over(running) for c in complete}
        | {f"{c}_n": F.sum(F.col(f"{c}_ok").cast("int")).over(running) for c in complete}
    )
    # complete rows before the stretch: the count at its first row, without that row itself
    before = {c: F.col(f"{c}_n") - F.col(f"{c}_ok").cast("int") for c in complete}
    df = df.withColumns(
        {f"{c}_before": F.max(F.when(broken[c], before[c])).over(running) for c in complete}
    )
    place = {
        c: F.when(F.col(f"{c}_ok"), F.col(f"{c}_n") - F.coalesce(F.col(f"{c}_before"), F.lit(0)))
        for c in complete
    }
    last = {
        c: F.max(F.when(F.col(f"{c}_ok"), F.struct(place[c].alias("n"), (-F.col(f"{c}_run")).alias("r")))).over(whole)
        for c in complete
    }
    df = df.withColumns({f"{c}_best": last[c] for c in complete})
    df = df.withColumns(
        {f"{c}_at": F.when(F.col(f"{c}_best")["r"] == -F.col(f"{c}_run"), place[c]) for c in complete}
    )
    return df.drop("_gap", *[f"{c}{end}" for c in complete for end in ("_ok", "_run", "_n", "_before", "_best")])


def longest_run(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], freq: str | None = None
) -> DataFrame:
    """Keep, per key, the longest stretch of rows in which all values are present.

    With ``freq``, a missing period ends a stretch as well. Ties go to the first.
    """
    complete = F.lit(True)
    for v in values:
        complete = complete & F.col(v).isNotNull()
    return _runs(df, keys, {"_all": complete}, freq).filter("_all_at IS NOT NULL").select(*df.columns)


def cross_correlation(
    df: DataFrame,
    keys: Sequence[str],
    target: str,
    predictors: Sequence[str],
    lag_max: int,
    freq: str | None = None,
    both_sides: bool = True,
) -> DataFrame:
    """``(keys, predictor, lag, n, ccf)`` for lags ``-lag_max .. lag_max``.

    At lag ``-k`` the target at t meets the predictor at t - k. Means and
    denominators span the whole common stretch of both series. With
    ``both_sides=False`` only lags ``-lag_max .. 0`` are returned. A predictor without
    a common row has no rows for that key. All predictors are served by windows and one
    aggregation over the key: rows are neither copied per predictor nor shuffled again.
    """
    ids = [f"_x{i}" for i in range(len(predictors))]
    rows = df.select(
        *keys, "period", F.col(target).cast("double").alias("_y"),
        *[F.col(p).cast("double").alias(x) for p, x in zip(predictors, ids)],
    )
    rows = _runs(rows, keys, {x: F.col("_y").isNotNull() & F.col(x).isNotNull() for x in ids}, freq)
    whole, order = Window.partitionBy(*keys), by_period(keys)
    lags = range(1, lag_max + 1)
    inside = {x: F.col(f"{x}_at").isNotNull() for x in ids}
    rows = rows.withColumns(
        {f"{x}_my": F.avg(F.when(inside[x], F.col("_y"))).over(whole) for x in ids}
        | {f"{x}_mx": F.avg(F.when(inside[x], F.col(x))).over(whole) for x in ids}
        | {f"{x}_{k}": F.lag(x, k).over(order) for x in ids for k in lags}
        | ({f"_y_{k}": F.lag("_y", k).over(order) for k in lags} if both_sides else {})
    )
    steps = [*range(-lag_max, lag_max + 1)] if both_sides else [*range(-lag_max, 1)]
    sums, entries = [], []
    for name, x in zip(predictors, ids):
        my, mx, at = F.col(f"{x}_my"), F.col(f"{x}_mx"), F.col(f"{x}_at")
        ey, ex = F.col("_y") - my, F.col(x) - mx
        sums.append(F.count(at).alias(f"{x}_n"))
        scale = F.sqrt(F.sum(F.when(inside[x], ey * ey)) * F.sum(F.when(inside[x], ex * ex)))
        products = []
        for k in steps:
            # the row k places before lies in the same stretch
            if k < 0:
                product = ey * (F.col(f"{x}_{-k}") - mx)
            else:
                product = (F.col(f"_y_{k}") - my if k else ey) * ex
            products.append(F.sum(F.when(at > abs(k), product)))
        sums += [scale.alias(f"{x}_scale"), F.array(*products).alias(f"{x}_sums")]
        entries += [
            F.struct(
                F.lit(name).alias("predictor"), F.lit(k).alias("lag"), F.col(f"{x}_n").alias("n"),
                F.try_divide(F.col(f"{x}_sums")[i], F.col(f"{x}_scale")).alias("ccf"),
            )
            for i, k in enumerate(steps)
        ]
    found = rows.groupBy(*keys).agg(*sums)
    long = found.select(*keys, F.inline(F.array(*entries))).filter("n > 0")
    return long.select(*keys, "predictor", "n", "lag", "ccf")


def autocorrelation(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    lag_max: int = 12,
    freq: str | None = None,
) -> DataFrame:
    """``(keys, lag, n, acf)`` for lags ``1 .. lag_max``: no self-join, one aggregation."""
    rows = longest_run(df.select(*keys, "period", F.col(value).alias("y")), keys, ["y"], freq)
    rows = rows.withColumn("e", F.col("y") - F.avg("y").over(Window.partitionBy(*keys)))
    rows = rows.withColumns(
        {f"e{k}": F.lag("e", k).over(by_period(keys)) for k in range(1, lag_max + 1)}
    )
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("e") * F.col("e")).alias("ee"),
        *[F.sum(F.col("e") * F.col(f"e{k}")).alias(f"p{k}") for k in range(1, lag_max + 1)],
    )
    entries = [
        F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"p{k}"), F.col("ee")).alias("acf"))
        for k in range(1, lag_max + 1)
    ]
    return sums.select(*keys, "n", F.inline(F.array(*entries)))


def correlation_table(
    ccf: DataFrame, keys: Sequence[str], predictors: Sequence[str], lag_max: int
) -> DataFrame:
    """One row per (key, lag) with a column per predictor, lags ``-lag_max .. 0``."""
    kept = ccf.filter(F.col("lag").between(-lag_max, 0))
    return widen(kept, [*keys, "lag"], predictors, "predictor", "ccf")


def seasonal_subseries(
    df: DataFrame, keys: Sequence[str], freq: str, value: str = "value"
) -> DataFrame:
    """Each value next to the mean of its season: ``(keys, period, season, value, season_mean)``."""
    season = season_of(F.col("period"), freq).cast("int")
    return df.select(
        *keys, "period", season.alias("season"), F.col(value).alias("value")
    ).withColumn("season_mean", F.avg("value").over(Window.partitionBy(*keys, "season")))


def as_series(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key with the columns as arrays in period order.

    Only for panels: a series is bounded by the calendar.
    """
    rows = F.array_sort(F.collect_list(F.struct("period", *columns)))
    return df.groupBy(*keys).agg(rows.alias("rows")).select(
        *keys, *[F.col("rows")[c].alias(c) for c in ("period", *columns)]
    )


# Lengths of series whose weights a worker keeps.
STL_PLANS = 50


def stl(df: DataFrame, keys: Sequence[str], freq: str, value: str = "value") -> DataFrame:
    """Seasonal-trend decomposition by loess, on the calendar.

    Returns one row per row of ``df``: ``(keys, period, value, trend, season, remainder, season_adjust,
    status)``. Missing periods and values have no weight in the local fits. ``status`` is ``ok``;
    ``missing`` where the value is (trend and season are there, the rest is null); ``short`` for
    keys with known values of less than two years, and ``sparse`` for keys with a stretch that no fit
    reaches: these have no parts.
    """
    m = FREQUENCIES[freq].seasons

    @F.pandas_udf("struct<trend: array<double>, season: array<double>>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        plans: dict[int, Plan] = {}
        for (values,) in pieces((values,) for values in batches):
            trend, season = ([None] * len(values) for _ in range(2))
            for n, members in values.groupby(values.str.len()).indices.items():
                if n < 2 * m:
                    continue
                plan = plans[n] if n in plans else Plan(n, m)
                if len(plans) < STL_PLANS:
                    plans[n] = plan
                for where in slices(members, n * plan.trend[0].shape[1]):
                    y = np.stack(values.iloc[where].to_numpy())
                    known = ~np.isnan(y)
                    parts = plan.decompose(np.where(known, y, 0.0), known)
                    for out, part in zip((trend, season), parts):
                        for w, row in zip(where, part):
                            out[w] = row
            yield pd.DataFrame({"trend": trend, "season": season})

    rows = df.select(*keys, "period", F.col(value).cast("double").alias("value"), F.lit(True).alias("own"))
    filled = fill_gaps(rows, keys, freq).withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    series = as_series(filled, keys, ["value", "own"])
    enough = F.size(F.filter("value", lambda v: ~F.isnan(v))) >= 2 * m
    parts = series.withColumn("enough", enough).withColumn("parts", F.when(F.col("enough"), split("value")))
    parts = parts.withColumn("whole", F.forall(F.concat("parts.trend", "parts.season"), lambda v: v.isNotNull() & ~F.isnan(v)))
    none = F.transform("value", lambda v: F.lit(None).cast("double"))
    shown = [F.when(F.col("whole"), F.col(f"parts.{c}")).otherwise(none).alias(c) for c in ("trend", "season")]
    out = parts.select(*keys, "period", "value", "own", "enough", "whole", *shown)
    out = out.select(*keys, "enough", "whole", F.inline(F.arrays_zip("period", "value", "own", "trend", "season"))).filter("own")
    known = F.when(~F.isnan("value"), F.col("value"))
    status = (
        F.when(~F.col("enough"), "short").when(~F.coalesce("whole", F.lit(False)), "sparse").when(F.isnan("value"), "missing").otherwise("ok")
    )
    return out.select(
        *keys, "period", known.alias("value"), "trend", "season", (known - F.col("trend") - F.col("season")).alias("remainder"),
        (known - F.col("season")).alias("season_adjust"), status.alias("status"),
    )


def seasonal_strength(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, strength)``: share of detrended variance that the season explains."""
    ratio = F.try_divide(
        F.var_pop("remainder"), F.var_pop(F.col("season") + F.col("remainder"))
    )
    return components.groupBy(*keys).agg(
        F.greatest(F.lit(0.0), 1 - F.coalesce(ratio, F.lit(1.0))).alias("strength")
    )
