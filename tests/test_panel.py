import datetime as dt

import numpy as np
import pandas as pd
from conftest import frame, periods, table
from pyspark.sql import functions as F

from tspanel.functions import coerce_numeric, format_period_label, parse_period_label, period_trunc
from tspanel.operators.panel import (
    align_left,
    duplicate_periods,
    fill_gaps,
    future_frame,
    future_predictors,
    melt,
    panel_contract,
    resample_mean,
    widen,
)
from tspanel.operators.transform import (
    add_events,
    add_lags,
    add_seasons,
    add_split,
    after_year,
    difference,
    difference_weights,
    pct_change,
    until_year,
)


def test_coerce_numeric_turns_markers_into_nulls(spark):
    df = spark.createDataFrame([("1.5",), (".",), ("",), (None,), ("-2",)], "v string")
    assert [r[0] for r in df.select(coerce_numeric(F.col("v"))).collect()] == [1.5, None, None, None, -2.0]


def test_labels_round_trip_and_reject_other_text(spark):
    df = spark.createDataFrame([(d,) for d in periods(30, "month")], "d date")
    for freq in ("month", "quarter"):
        label = format_period_label(period_trunc(F.col("d"), freq), freq)
        back = df.select(period_trunc(F.col("d"), freq).alias("p"), parse_period_label(label, freq).alias("q"))
        assert back.filter("p <> q or q is null").count() == 0
    bad = spark.createDataFrame([("2002 Q5",), ("2002Q1",), ("x",), ("2002 Foo",), (None,)], "v string")
    for freq in ("month", "quarter"):
        assert bad.filter(parse_period_label(F.col("v"), freq).isNotNull()).count() == 0


def test_resample_ignores_nulls_and_keeps_empty_groups_null(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2000, 1, 5), 1.0), ("a", dt.date(2000, 3, 5), 3.0),
         ("a", dt.date(2000, 2, 5), None), ("a", dt.date(2000, 4, 1), None)],
        "key string, d date, v double",
    )
    got = {r.period: r.v for r in resample_mean(df, ["key"], "d", "quarter", ["v"]).collect()}
    assert got == {dt.date(2000, 1, 1): 2.0, dt.date(2000, 4, 1): None}


def test_align_equals_left_joins(spark):
    p = periods(4)
    rows = [("t", p[0], 1.0), ("t", p[1], None), ("t", p[3], 4.0), ("x", p[1], 10.0), ("x", p[2], 20.0)]
    long = spark.createDataFrame(rows, "series string, period date, value double")
    got = {r.period: (r.t, r.x) for r in align_left(long, "t", ["x"]).collect()}
    assert got == {p[0]: (1.0, None), p[1]: (None, 10.0), p[3]: (4.0, None)}


def test_melt_then_widen_is_identity(spark):
    data = table(5, {"x": [1.0, np.nan, 3, 4, 5], "y": [5.0, 4, 3, np.nan, 1]})
    wide = frame(spark, data)
    back = widen(melt(wide, ["key", "period"], ["x", "y"]), ["key", "period"], ["x", "y"])
    assert back.exceptAll(wide.select(back.columns)).count() == 0
    assert melt(wide, ["key", "period"], ["x", "y"]).count() == 10


def test_pct_change_zero_and_null_denominators(spark):
    df = frame(spark, table(5, {"y": [1.0, 2, 0, 3, 4], "x": [np.nan, 1, 2, np.nan, 4]}))
    got = {r.period: (r.y, r.x) for r in pct_change(df, ["key"], ["y", "x"], "y").collect()}
    p = periods(5)
    # the first row and the row after a zero have no change of the target
    assert set(got) == {p[1], p[2], p[4]}
    assert got[p[1]] == (100.0, None) and got[p[2]] == (-100.0, 100.0)


def test_lags_shift_rows_not_periods(spark):
    data = table(5, {"x": [1.0, 2, 3, 4, 5]}).drop(index=2)
    got = {r.period: r.x_lag1 for r in add_lags(frame(spark, data), ["key"], [("x", 1)]).collect()}
    p = periods(5)
    assert got == {p[0]: None, p[1]: 1.0, p[3]: 2.0, p[4]: 4.0}


def test_difference_weights_match_polynomial():
    for d, D, m in [(0, 0, 4), (1, 0, 4), (2, 0, 4), (0, 1, 4), (1, 1, 12), (2, 1, 4)]:
        poly = np.array([1.0])
        for step in [1] * d + [m] * D:
            poly = np.convolve(poly, [1.0] + [0.0] * (step - 1) + [-1.0])
        assert difference_weights(d, D, m) == {i: int(c) for i, c in enumerate(poly) if c}


def test_difference_matches_numpy(spark):
    x = np.random.default_rng(0).normal(size=20)
    out = difference(frame(spark, table(20, {"x": x})), ["key"], ["x"], 1, 1, "quarter")
    got = out.orderBy("period").toPandas()["x"].to_numpy()
    want = np.diff(x[4:] - x[:-4])
    assert np.isnan(got[:5]).all() and np.allclose(got[5:], want)


def test_contract_reports_duplicates_gaps_and_misaligned(spark):
    p = periods(6)
    rows = [("ok", d) for d in p] + [("gap", d) for d in p if d != p[2]]
    rows += [("dup", d) for d in p] + [("dup", p[1])] + [("off", p[0]), ("off", dt.date(2000, 5, 2))]
    df = spark.createDataFrame(rows, "key string, period date")
    got = {r.key: r for r in panel_contract(df, ["key"], "quarter").collect()}
    assert got["ok"].is_regular and not got["gap"].is_regular and not got["dup"].is_regular
    assert got["gap"].n_gaps == 1 and got["dup"].n_duplicated == 1 and got["off"].n_misaligned == 1
    assert [(r.key, r.n) for r in duplicate_periods(df, ["key"]).collect()] == [("dup", 2)]


def test_fill_gaps_and_future(spark):
    data = table(6, {"x": [1.0, 2, 3, 4, 5, 6]}).drop(index=[2, 3])
    full = fill_gaps(frame(spark, data), ["key"], "quarter").orderBy("period").toPandas()
    assert list(full["period"]) == periods(6)
    assert full["x"].isna().tolist() == [False, False, True, True, False, False]
    future = future_frame(frame(spark, data), ["key"], "quarter", 3)
    assert [r.period for r in future.orderBy("h").collect()] == periods(9)[6:]
    ahead = spark.createDataFrame(
        [("a", "x", periods(9)[7], 9.0)], "key string, series string, period date, mean double"
    )
    filled = future_predictors(future, ahead, ["key"], ["x"], ["pulse"]).orderBy("h").collect()
    assert [r.x for r in filled] == [None, 9.0, None] and all(r.pulse == 0.0 for r in filled)


def test_calendar_columns(spark):
    df = frame(spark, table(8, {"x": np.arange(8.0)}))
    out = add_events(add_seasons(df, "quarter", intercept=False), {"e": periods(8)[3]})
    rows = out.orderBy("period").toPandas()
    assert rows["e"].tolist() == [0, 0, 0, 1, 0, 0, 0, 0]
    assert (rows[[f"season_{j}" for j in range(1, 5)]].sum(axis=1) == 1).all()
    assert "season_1" not in add_seasons(df, "quarter").columns
    split = add_split(df, 2000).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 4, "test": 4}
    assert until_year(df, 2000).count() == after_year(df, 2000).count() == 4


def test_year_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "panel")
    frame(spark, table(40, {"x": np.arange(40.0)})).write.parquet(path)
    plan = after_year(spark.read.parquet(path), 2005)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(period,2006-01-01)" in plan


def test_results_do_not_depend_on_partitioning_or_order(spark):
    data = pd.concat([table(30, {"x": np.sin(np.arange(30.0) + i) + 3}, key=str(i)) for i in range(5)])
    df = frame(spark, data)
    one = pct_change(df, ["key"], ["x"], "x")
    two = pct_change(df.orderBy(F.rand(1)).repartition(7), ["key"], ["x"], "x")
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_a_hot_key_is_combined_before_the_shuffle(spark):
    raw = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 700).cast("int")).alias("d"),
        F.col("id").cast("double").alias("v"),
    )
    out = resample_mean(raw, ["key"], "d", "quarter", ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(key") < plan.index("partial_avg")
    assert out.filter("key = 'hot'").count() == 8


def test_fill_gaps_keeps_repeated_periods(spark):
    days = [dt.date(2000, 1, 1), dt.date(2000, 2, 1), dt.date(2000, 2, 1), dt.date(2000, 4, 1)]
    df = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days)], "key string, period date, value double")
    got = sorted((r.period.month, r.value) for r in fill_gaps(df, ["key"], "month").collect() if r.value is not None)
    assert got == [(1, 0.0), (2, 1.0), (2, 2.0), (4, 3.0)] and fill_gaps(df, ["key"], "month").count() == 5


def test_only_plain_numbers_are_read(spark):
    texts = ["1", " -2.5 ", ".5", "3e2", ".", "NaN", "Infinity", "1d", "2f", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(coerce_numeric(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [1.0, -2.5, 0.5, 300.0] + [None] * 7
