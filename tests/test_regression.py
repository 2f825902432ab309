import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from conftest import frame, periods, table
from pyspark.sql import functions as F

from tspanel.functions.distributions import beta_cdf, t_two_sided
from tspanel.operators.describe import autocorrelation, correlation_table, cross_correlation
from tspanel.operators.forecast import forecast_regressions
from tspanel.operators.regression import (
    coefficient_table,
    fit_regressions,
    glance,
    report,
    residuals,
)
from tspanel.operators.score import accuracy, aicc_leaderboard, rmse_leaderboard
from tspanel.operators.spec import Lag, Pulse, Regression
from tspanel.operators.tables import history_with_forecast, residual_acf, residual_histogram
from tspanel.operators.transform import pct_change, until_year
from tspanel.plans.compare import select_and_refit
from tspanel.session import BUCKETS, clear_stages, stage

KEYS = ["key"]
N = 48


def brute_design(data, model, m=4):
    """The plain design matrix of one series, columns as the fit names them."""
    period = pd.Series(data["period"])
    columns = {}
    season = period.map(lambda d: (d.month - 1) // (12 // m) + 1)
    if model.intercept:
        columns["intercept"] = np.ones(len(data))
    if model.season:
        for j in range(2 if model.intercept else 1, m + 1):
            columns[f"season_{j}"] = (season == j).to_numpy(float)
    for p in model.pulses:
        columns[p.name] = (period == p.period).to_numpy(float)
    for lag in model.lags:
        columns[lag.name] = data[lag.column].shift(lag.k).to_numpy()
    x = np.column_stack(list(columns.values()))
    y = data[model.target].to_numpy()
    ok = ~np.isnan(x).any(axis=1) & ~np.isnan(y)
    return list(columns), x, y, ok


def series(seed, shift=0.0, n=N):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n) + shift, rng.normal(size=n)
    y = shift + 0.7 * np.r_[0, x[:-1]] + 0.4 * z + np.arange(n) % 4 + rng.normal(0, 0.3, n)
    return table(n, {"y": y, "x": x, "z": z}, key=str(seed))


PULSE = Pulse("shock", periods(N)[20])
MODELS = [
    Regression("full", "y", season=True, lags=(Lag("x", 1), Lag("z", 0)), pulses=(PULSE,)),
    Regression("bare", "y", season=True, intercept=False, lags=(Lag("x", 1),)),
    Regression("flat", "y", lags=(Lag("x", 3),)),
    Regression("origin", "y", intercept=False, lags=(Lag("x", 0), Lag("z", 2))),
    Regression("mean", "y"),
    Regression("late", "y", season=True, lags=(Lag("x", 9), Lag("y", 1))),
]


@pytest.fixture(scope="module")
def data():
    return {k: series(k) for k in range(3)} | {9: series(9, shift=1e6)}


@pytest.fixture(scope="module")
def df(spark, data):
    return frame(spark, pd.concat(data.values())).cache()


@pytest.fixture(scope="module")
def fits(df):
    return fit_regressions(df, KEYS, MODELS, "quarter").cache()


def test_fits_match_least_squares(data, fits):
    table_ = {(r.key, r.model): r for r in fits.collect()}
    errors = {(r.key, r.model, r.term): r for r in coefficient_table(fits, KEYS).collect()}
    for seed, series_ in data.items():
        for model in MODELS:
            names, x, y, ok = brute_design(series_, model)
            x, y = x[ok], y[ok]
            beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
            sse = ((y - x @ beta) ** 2).sum()
            r = table_[(str(seed), model.name)]
            # the plain least squares of the large level has fewer digits than the fit
            tolerance = 1e-8 if seed != 9 else 1e-4
            assert (r.n, r.rank) == (len(y), rank)
            assert r.sse == pytest.approx(sse, rel=tolerance)
            for name, b in zip(names, beta):
                assert r.coef[name] == pytest.approx(b, rel=tolerance, abs=tolerance)
            aic = len(y) * np.log(sse / len(y)) + 2 * (rank + 1)
            assert r.aicc == pytest.approx(
                aic + 2 * (rank + 1) * (rank + 2) / (len(y) - rank - 2), abs=tolerance * 10
            )
            se = np.sqrt(np.diag(np.linalg.pinv(x.T @ x)) * sse / (len(y) - rank))
            if seed != 9:
                for name, s in zip(names, se):
                    assert errors[(str(seed), model.name, name)].std_error == pytest.approx(s, rel=1e-6)


def test_origin_fits_keep_their_digits_at_huge_levels(spark):
    """Against exact rational least squares."""
    from fractions import Fraction

    rng = np.random.default_rng(3)
    n, level = 40, 10**9
    u, v, w = rng.integers(-40, 40, (3, n))
    shock = periods(n)[7]
    data = table(n, {"y": level + u + 2 * v + w // 4, "x": level + u, "z": level + v}).astype({c: float for c in "yxz"})
    models = [
        Regression("two", "y", intercept=False, lags=(Lag("x", 0), Lag("z", 0))),
        Regression("lagged", "y", intercept=False, lags=(Lag("x", 0), Lag("z", 1), Lag("y", 2))),
        Regression("pulsed", "y", intercept=False, lags=(Lag("x", 0), Lag("z", 0)), pulses=(Pulse("shock", shock),)),
        Regression("copied", "y", intercept=False, lags=(Lag("x", 0), Lag("x2", 0))),
        Regression("constant", "y", lags=(Lag("x", 0), Lag("z", 0))),
    ]
    data["x2"] = data["x"] * 2
    got = {r.model: r for r in fit_regressions(frame(spark, data), KEYS, models, "quarter").collect()}
    assert got["copied"].rank == 1 and got["copied"].coef[Lag("x2", 0).name] is None
    for m in models:
        if m.name == "copied":
            continue
        names, x, y, ok = brute_design(data, m)
        x, y = ([[Fraction(int(e)) for e in row] for row in x[ok]], [Fraction(int(e)) for e in y[ok]])
        p = len(names)
        a = [[sum(r[i] * r[j] for r in x) for j in range(p)] + [sum(r[i] * t for r, t in zip(x, y))] for i in range(p)]
        for i in range(p):
            a[i] = [e / a[i][i] for e in a[i]]
            for j in range(p):
                if j != i:
                    a[j] = [e - a[j][i] * f for e, f in zip(a[j], a[i])]
        beta = [a[i][p] for i in range(p)]
        sse = sum((t - sum(b * e for b, e in zip(beta, r))) ** 2 for r, t in zip(x, y))
        assert got[m.name].rank == p
        assert got[m.name].sse == pytest.approx(float(sse), rel=1e-8)
        for name, b in zip(names, beta):
            assert got[m.name].coef[name] == pytest.approx(float(b), rel=1e-8, abs=1e-8)


def test_aliased_and_absent_columns(spark):
    base = series(5)
    base["copy"] = base["x"] * 2
    base["void"] = np.nan
    outside = Pulse("outside", dt.date(1990, 1, 1))
    models = [
        Regression("twice", "y", lags=(Lag("x", 1), Lag("copy", 1)), pulses=(outside,)),
        Regression("void", "y", lags=(Lag("void", 0),)),
    ]
    rows = fit_regressions(frame(spark, base), KEYS, models, "quarter").collect()
    # a model without complete rows has no fit; it does not disturb the others
    assert [r.model for r in rows] == ["twice"]
    r = rows[0]
    assert r.rank == 2 and r.coef["copy_lag1"] is None and r.coef["outside"] is None
    alone = fit_regressions(
        frame(spark, base), KEYS, [Regression("one", "y", lags=(Lag("x", 1),))], "quarter"
    ).first()
    assert r.coef["x_lag1"] == pytest.approx(alone.coef["x_lag1"])


def test_a_pulse_equals_leaving_the_row_out(df, fits):
    kept = df.withColumn("y", F.when(F.col("period") != F.lit(PULSE.period), F.col("y")))
    model = Regression("full", "y", season=True, lags=(Lag("x", 1), Lag("z", 0)))
    left = {r.key: r.coef for r in fit_regressions(kept, KEYS, [model], "quarter").collect()}
    for r in fits.filter("model = 'full' and key <> '9'").collect():
        for term, b in left[r.key].items():
            assert r.coef[term] == pytest.approx(b, abs=1e-9)


def test_single_row_and_repeated_names(spark):
    one = frame(spark, table(1, {"y": [3.0]}))
    r = fit_regressions(one, KEYS, [Regression("m", "y")], "quarter").first()
    assert (r.n, r.rank, r.coef["intercept"], r.sigma2, r.aicc) == (1, 1, 3.0, None, None)
    with pytest.raises(ValueError):
        fit_regressions(one, KEYS, [Regression("m", "y"), Regression("m", "y")], "quarter")


def test_equal_models_are_fitted_once(df, fits):
    twin = Regression("twin", "y", lags=(Lag("x", 3),))
    both = fit_regressions(df, KEYS, [*MODELS, twin], "quarter")
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("struct(model, ") == len(MODELS)
    rows = {(r.key, r.model): r.sse for r in both.collect()}
    assert len(rows) == 4 * 7 and all(rows[(str(k), "twin")] == rows[(str(k), "flat")] for k in (0, 1, 2, 9))


def test_only_restricts_models_per_key(spark, df, fits):
    only = spark.createDataFrame([("0", ["flat"]), ("1", ["full", "mean"])], "key string, models array<string>")
    some = fit_regressions(df, KEYS, MODELS, "quarter", only)
    assert {(r.key, r.model) for r in some.collect()} == {("0", "flat"), ("1", "full"), ("1", "mean")}
    both = some.select("key", "model", F.round("sse", 8)).exceptAll(fits.select("key", "model", F.round("sse", 8)))
    assert both.count() == 0


def test_forecasts_match_brute_force_with_lags_across_the_border(data, df):
    train = until_year(df, 2009)
    test = df.filter("period >= '2010-01-01'")
    fits = fit_regressions(train, KEYS, MODELS, "quarter").cache()
    out = forecast_regressions(train, test, fits, KEYS, MODELS, "quarter")
    got = {(r.key, r.model, r.period): r for r in out.filter("key <> '9'").collect()}
    for seed in range(3):
        for model in MODELS:
            _, x, y, ok = brute_design(data[seed], model)
            past = np.array([d.year <= 2009 for d in data[seed]["period"]])
            xt, yt = x[ok & past], y[ok & past]
            beta, _, rank, _ = np.linalg.lstsq(xt, yt, rcond=None)
            sigma2 = ((yt - xt @ beta) ** 2).sum() / (len(yt) - rank)
            inverse = np.linalg.pinv(xt.T @ xt)
            for i in np.flatnonzero(~past):
                r = got[(str(seed), model.name, data[seed]["period"].iloc[i])]
                assert r.h == i - past.sum() + 1 and r.actual == y[i]
                assert r.mean == pytest.approx(x[i] @ beta, abs=1e-8)
                sigma = np.sqrt(sigma2 * (1 + x[i] @ inverse @ x[i]))
                assert r.sigma == pytest.approx(sigma, rel=1e-8)
                assert r.hi95 - r.lo95 == pytest.approx(2 * 1.959963984540054 * sigma)
    scores = accuracy(out, KEYS)
    again = accuracy(out, KEYS, test, "y")
    assert scores.select("key", "model", F.round("rmse", 9)).exceptAll(
        again.select("key", "model", F.round("rmse", 9))
    ).count() == 0
    frame_ = out.filter("key = '0' and model = 'full'").toPandas().sort_values("period")
    e = (frame_["actual"] - frame_["mean"]).to_numpy()
    r = scores.filter("key = '0' and model = 'full'").first()
    assert r.rmse == pytest.approx(np.sqrt((e**2).mean())) and r.me == pytest.approx(e.mean())
    c = e - e.mean()
    assert r.acf1 == pytest.approx((c[1:] * c[:-1]).sum() / (c**2).sum())
    assert r.mape == pytest.approx(np.abs(100 * e / frame_["actual"]).mean())
    ranks = rmse_leaderboard(scores, KEYS).filter("key = '0'").orderBy("rank").collect()
    assert [x.rmse for x in ranks] == sorted(x.rmse for x in ranks)
    both = history_with_forecast(train, out, KEYS, "y")
    assert both.filter("kind = 'history'").count() == train.count()


def test_boards_and_tables(df, fits):
    board = aicc_leaderboard(fits, KEYS).filter("key = '1'").orderBy("rank").collect()
    assert [r.aicc for r in board] == sorted(r.aicc for r in board) and board[0].rank == 1
    assert "coef" not in glance(fits, KEYS).columns
    full = report(fits.filter("key = '1' and model = 'full'"), KEYS)
    assert {"term", "estimate", "aicc"} <= set(full.columns) and full.count() == 7
    left = residuals(df, fits, KEYS, MODELS, "quarter").cache()
    sums = left.filter("model = 'full' and key <> '9'").groupBy("key").agg(F.sum("residual").alias("s"))
    assert all(abs(r.s) < 1e-8 for r in sums.collect())
    bins = residual_histogram(left, KEYS, bins=7)
    assert bins.filter("bin < 1 or bin > 7").count() == 0
    assert bins.agg(F.sum("n")).first()[0] == left.count()
    assert residual_acf(left, KEYS).filter("abs(acf) > 1").count() == 0


def test_student_p_values(spark):
    # two-sided tail areas of well-known quantiles
    t = [12.706204736, 2.228138852, 1.959963985, 0.0, 2.0, -2.0, None, 1.0]
    df = [1.0, 10.0, 1e7, 5.0, 60.0, 60.0, 3.0, 0.0]
    want = [0.05, 0.05, 0.05, 1.0, 0.0500331, 0.0500331, None, None]
    rows = spark.createDataFrame(list(zip(t, df, want)), "t double, df double, want double")
    for r in rows.withColumn("p", t_two_sided(F.col("t"), F.col("df"))).collect():
        assert r.p == (None if r.want is None else pytest.approx(r.want, abs=1e-6))


def test_beta_distribution_equals_binomial_sums(spark):
    """For whole parameters the distribution is a sum of binomial probabilities."""
    import math

    cases = [(x, a, b) for x in (0.0, 0.003, 0.2, 0.5, 0.9, 1.0) for a in (1, 2, 7, 40) for b in (1, 3, 25, 90)]
    rows = spark.createDataFrame([(x, float(a), float(b)) for x, a, b in cases], "x double, a double, b double")
    got = rows.withColumn("p", beta_cdf(F.col("x"), F.col("a"), F.col("b"))).collect()
    for r, (x, a, b) in zip(got, cases):
        n = a + b - 1
        want = sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))
        assert r.p == pytest.approx(want, abs=1e-12)


def test_the_fit_needs_one_exchange_of_the_panel(spark, df):
    """The window, both aggregations and the solve share one partitioning by key."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fit_regressions(df, KEYS, MODELS[:2], "quarter")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in plan


@pytest.fixture
def buckets(spark):
    spark.conf.set(BUCKETS, spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    clear_stages(spark)
    for name in (BUCKETS, "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(name)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_passes_over_a_panel_staged_by_key_need_no_exchange(spark, df, buckets):
    panel = stage(df, KEYS)
    grown = pct_change(panel, KEYS, ["y", "x", "z"], "y")
    fits = stage(fit_regressions(grown, KEYS, MODELS[:3], "quarter"), KEYS)
    passes = {
        "growth": grown,
        "acf": autocorrelation(panel, KEYS, "y", 6, "quarter"),
        "ccf": correlation_table(cross_correlation(panel, KEYS, "y", ["x", "z"], 6), KEYS, ["x", "z"], 6),
        "fit": fit_regressions(panel, KEYS, MODELS, "quarter"),
        "residuals": residuals(grown, fits, KEYS, MODELS[:3], "quarter"),
        "accuracy": accuracy(forecast_regressions(panel, panel, fits, KEYS, MODELS[:3], "quarter"), KEYS),
        "ranks": aicc_leaderboard(fits, KEYS),
    }
    for name, out in passes.items():
        # Python steps forget how rows were dealt: the profiles of fits, a row per key and model, move once;
        # so does the union of history and future
        moved = [x for x in plan_of(out).splitlines() if "Exchange " in x]
        assert len(moved) == {"residuals": 1, "accuracy": 2}.get(name, 0), name
        assert out.count() > 0
    plain = {(r.key, r.model): r.sse for r in fit_regressions(df, KEYS, MODELS, "quarter").collect()}
    assert {(r.key, r.model): r.sse for r in passes["fit"].collect()} == pytest.approx(plain, rel=1e-9)


def test_stages_by_key_hold_nulls_and_go_when_cleared(spark, buckets):
    rows = spark.createDataFrame([(None, 1, 2.0), ("a", 1, None), ("a", 1, None)], "`key` string, `odd name` int, x double")
    kept = stage(rows, ["key", "odd name"])
    assert kept.exceptAll(rows).count() == 0 and kept.count() == 3
    assert stage(rows.limit(0), ["key"], 2).columns == rows.columns
    files = kept.inputFiles()
    clear_stages(spark)
    assert files and not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in files)


def test_select_and_refit_is_the_same_over_bucketed_stages(spark, df, buckets):
    def run():
        board, fits = select_and_refit(df, KEYS, MODELS[:3], "quarter", 2008)
        return (
            {(r.key, r.model): r.rmse for r in board.collect()},
            {(r.key, r.model): r.sse for f in fits for r in f.collect()},
        )

    bucketed = run()
    spark.conf.set(BUCKETS, "0")
    for got, want in zip(bucketed, run()):
        assert got == pytest.approx(want, rel=1e-9)
