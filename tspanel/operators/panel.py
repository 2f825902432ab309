"""Build panels: resample, align, reshape, check and extend."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tspanel.functions import FREQUENCIES, period_add, period_index, period_trunc


def by_period(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("period")


def resample(
    df: DataFrame, keys: Sequence[str], date: str, freq: str, aggs: Mapping[str, Column]
) -> DataFrame:
    """Aggregate raw rows to one row per (key, period).

    The aggregates combine before the shuffle, so a key that holds a large part of
    the raw rows sends one row per period and task.
    """
    return df.groupBy(*keys, period_trunc(F.col(date), freq).alias("period")).agg(
        *[c.alias(name) for name, c in aggs.items()]
    )


def resample_mean(
    df: DataFrame, keys: Sequence[str], date: str, freq: str, values: Sequence[str]
) -> DataFrame:
    """Mean per period, ignoring nulls; a period with nulls only gives null."""
    return resample(df, keys, date, freq, {v: F.avg(v) for v in values})


def align_left(
    panel: DataFrame,
    target: str,
    series: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "series",
    value: str = "value",
) -> DataFrame:
    """Long panel to a wide table on the calendar of ``target``.

    Equal to left-joining every series to the target on (key, period), in a single
    aggregation: periods without a target row are dropped, and predictors without
    a row are null.
    """
    columns = [target, *[s for s in series if s != target]]
    wide = panel.groupBy(*keys, "period").agg(
        F.max(F.col(name) == target).alias("has_target"),
        *[F.max(F.when(F.col(name) == s, F.col(value))).alias(s) for s in columns],
    )
    return wide.filter("has_target").select(*keys, "period", *columns)


def melt(
    wide: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    name: str = "series",
    value: str = "value",
) -> DataFrame:
    """Wide to long; nulls are kept."""
    return wide.unpivot(list(ids), list(values), name, value)


def widen(
    long: DataFrame,
    ids: Sequence[str],
    names: Sequence[str],
    name: str = "series",
    value: str = "value",
) -> DataFrame:
    """Long to wide for a known list of names, in one aggregation."""
    return long.groupBy(*ids).agg(
        *[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    )


def panel_contract(df: DataFrame, keys: Sequence[str], freq: str) -> DataFrame:
    """One row per key: is (key, period) unique and the step regular?

    Counts combine before each shuffle; the second shuffle moves one row per
    (key, period) group only.
    """
    step = FREQUENCIES[freq].months
    cells = df.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("n"))
    span = (F.months_between("last_period", "first_period") / step + 1).cast("bigint")
    aligned = F.col("period") == F.trunc("period", freq)
    return (
        cells.groupBy(*keys)
        .agg(
            F.sum("n").alias("n_rows"),
            F.count("period").alias("n_periods"),
            F.sum((F.col("n") > 1).cast("bigint")).alias("n_duplicated"),
            F.sum((~F.coalesce(aligned, F.lit(False))).cast("bigint")).alias("n_misaligned"),
            F.min("period").alias("first_period"),
            F.max("period").alias("last_period"),
        )
        .withColumn("n_gaps", span - F.col("n_periods"))
        .withColumn(
            "is_regular",
            (F.col("n_duplicated") == 0) & (F.col("n_misaligned") == 0) & (F.col("n_gaps") == 0),
        )
    )


def duplicate_periods(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The (key, period) pairs that occur more than once."""
    return df.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def fill_gaps(df: DataFrame, keys: Sequence[str], freq: str) -> DataFrame:
    """Insert the missing periods between the first and last of each key, values null.

    Each row looks one row ahead and emits itself plus the periods up to the next
    one: no calendar join.
    """
    values = [c for c in df.columns if c not in (*keys, "period")]
    following = F.lead("period").over(by_period(keys))
    steps = F.coalesce(
        period_index(following, freq) - period_index(F.col("period"), freq), F.lit(1)
    )
    steps = F.greatest(steps, F.lit(1))  # repeated periods stay as they are
    spread = df.withColumn("step", steps).select(
        *df.columns, F.explode(F.sequence(F.lit(0), F.col("step") - 1)).alias("ahead")
    )
    return spread.select(
        *keys,
        period_add(F.col("period"), F.col("ahead"), freq).alias("period"),
        *[F.when(F.col("ahead") == 0, F.col(v)).alias(v) for v in values],
    )


def future_frame(df: DataFrame, keys: Sequence[str], freq: str, h: int) -> DataFrame:
    """The next ``h`` periods of every key: ``(keys, h, period)``."""
    last = df.groupBy(*keys).agg(F.max("period").alias("last"))
    return last.select(
        *keys, "last", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("h")
    ).select(*keys, "h", period_add(F.col("last"), F.col("h"), freq).alias("period"))


def future_predictors(
    future: DataFrame,
    forecasts: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    zeros: Sequence[str] = (),
) -> DataFrame:
    """Fill a future frame with predictor forecasts, matched by (key, period).

    ``forecasts`` is long: ``(keys, series, period, mean)``. Columns in ``zeros``
    (event pulses) are set to 0.
    """
    wide = widen(forecasts, [*keys, "period"], names, "series", "mean")
    return future.join(wide, [*keys, "period"], "left").select(
        *future.columns, *names, *[F.lit(0.0).alias(z) for z in zeros]
    )
