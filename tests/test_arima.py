import numpy as np
import pandas as pd
import pytest
from conftest import frame, periods, table
from pyspark.sql import functions as F

from tspanel.operators import arma
from tspanel.operators.arima import arima_residuals, choose_differences, fit_arima, forecast_arima
from tspanel.operators.panel import future_frame
from tspanel.operators.regression import coefficient_table, fit_regressions
from tspanel.operators.score import aicc_leaderboard
from tspanel.operators.spec import Arima, Lag, Pulse, Regression, as_arima
from tspanel.plans.compare import forecast_predictors, forecast_two_stage, select_and_refit

KEYS = ["key"]


def simulate(ar, ma, n, keys, seed, name, m=4, freq="quarter", integrate=0):
    """Panel of ``keys`` series; ``ar`` and ``ma`` map lags to coefficients."""
    rng = np.random.default_rng(seed)
    burn = 200
    e = rng.normal(size=(keys, n + burn))
    y = np.zeros_like(e)
    for t in range(n + burn):
        y[:, t] = e[:, t]
        for i, c in ar.items():
            y[:, t] += c * (y[:, t - i] if t >= i else 0)
        for j, c in ma.items():
            y[:, t] += c * (e[:, t - j] if t >= j else 0)
    y = y[:, burn:]
    for _ in range(integrate):
        y = np.cumsum(y, axis=1)
    return pd.concat([table(n, {"y": row}, key=f"{name}{i}", freq=freq) for i, row in enumerate(y)])


def fixed(name, p=0, q=0, P=0, Q=0, d=0, D=0, **kw):
    return Arima(name, "y", p, d, q, P, D, Q, **kw)


def test_step_down_matches_roots():
    rng = np.random.default_rng(0)
    coef = rng.normal(scale=0.6, size=(300, 4))
    want = [np.all(np.abs(np.roots(np.r_[1, -c])) < 1) for c in coef]
    assert (arma.is_stable(coef) == want).all()


def test_levinson_matches_toeplitz_solve():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(4, 300)).cumsum(axis=1) * 0.1 + rng.normal(size=(4, 300))
    cov = np.stack([(u[:, k:] * u[:, : 300 - k]).sum(axis=1) for k in range(5)], axis=1)
    got = arma.levinson(cov, 4, False, np.full(4, 300.0))
    for row, c in zip(got, cov):
        toeplitz = c[np.abs(np.subtract.outer(range(4), range(4)))]
        assert np.allclose(row, np.linalg.solve(toeplitz, c[1:]))


def test_expand_is_polynomial_product():
    got = arma.expand(np.array([[0.5, 0.2]]), 1, 1, 4)[0]
    poly = np.convolve(np.convolve([1, -0.5, -0.2], [1, -1]), [1, 0, 0, 0, -1])
    assert np.allclose(got, -poly[1:])


@pytest.fixture(scope="module")
def simulated(spark):
    return {
        "ar1": frame(spark, simulate({1: 0.6}, {}, 500, 30, 1, "a")),
        "ma1": frame(spark, simulate({}, {1: 0.5}, 500, 30, 2, "b")),
        "arma": frame(spark, simulate({1: 0.6}, {1: 0.4}, 500, 30, 3, "c")),
        "seasonal": frame(spark, simulate({1: 0.3, 4: 0.5}, {}, 500, 30, 4, "d")),
    }


@pytest.mark.parametrize(
    "name,spec,want",
    [
        ("ar1", fixed("m", p=1), {"ar1": 0.6}),
        ("ma1", fixed("m", q=1), {"ma1": 0.5}),
        ("arma", fixed("m", p=1, q=1), {"ar1": 0.6, "ma1": 0.4}),
        ("seasonal", fixed("m", p=1, P=1, multiplicative=False), {"ar1": 0.3, "ar4": 0.5}),
    ],
)
def test_parameters_are_recovered_on_average(simulated, name, spec, want):
    fits = fit_arima(simulated[name], KEYS, [spec], "quarter").toPandas()
    assert len(fits) == 30 and fits["stable"].all()
    for term, value in want.items():
        assert np.mean([dict(c)[term] for c in fits["coef"]]) == pytest.approx(value, abs=0.03)
    assert fits["sigma2"].mean() == pytest.approx(1, abs=0.05)


def test_order_search_finds_the_order_often(simulated):
    grid = Arima("g", "y", (0, 2), 0, (0, 2), 0, 0, 0)
    fits = fit_arima(simulated["arma"], KEYS, [grid], "quarter").toPandas()
    assert ((fits["p"] == 1) & (fits["q"] == 1)).mean() >= 1 / 3
    assert fits["orders"].str.startswith("ARIMA(").all()


def test_joint_steps_lower_the_error(simulated):
    spec = [fixed("m", p=1, q=1)]
    rough = fit_arima(simulated["arma"], KEYS, spec, "quarter", refine=0).toPandas()
    fine = fit_arima(simulated["arma"], KEYS, spec, "quarter").toPandas()
    both = rough.merge(fine, on="key")
    assert (both["sse_y"] <= both["sse_x"] + 1e-9).all()


def test_differences_are_chosen(spark):
    walk = simulate({}, {}, 200, 8, 5, "walk", integrate=1)
    flat = simulate({1: 0.3}, {}, 200, 8, 6, "flat")
    rng = np.random.default_rng(7)
    season = pd.concat(
        [
            table(120, {"y": np.tile(rng.normal(0, 5, 4), 30) + rng.normal(size=120)}, key=f"season{i}")
            for i in range(8)
        ]
    )
    df = frame(spark, pd.concat([walk, flat, season]))
    got = choose_differences(df, KEYS, [Regression("b", "y")], "quarter").toPandas()
    kind = got["key"].str.replace(r"\d", "", regex=True)
    assert (got.loc[kind == "walk", "d0"] == 1).mean() > 0.7
    assert (got.loc[kind == "flat", "d0"] == 0).mean() > 0.7
    assert (got.loc[kind == "season", "sd"] == 1).all() and (got.loc[kind != "season", "sd"] == 0).all()
    auto = fit_arima(df, KEYS, [Arima("auto", "y"), Arima("d1", "y", d=1, D=0)], "quarter").toPandas()
    assert len(auto) == 48 and (auto.loc[auto["model"] == "d1", "d"] == 1).all()
    walks = auto[(auto["model"] == "auto") & auto["key"].str.startswith("walk")]
    assert (walks["d"] == 1).mean() > 0.7


def test_zero_orders_equal_the_regression(spark):
    rng = np.random.default_rng(8)
    data = table(60, {"y": rng.normal(size=60), "x": rng.normal(size=60)})
    df = frame(spark, data)
    pulse = Pulse("shock", periods(60)[30])
    model = Regression("m", "y", season=True, lags=(Lag("x", 1),), pulses=(pulse,))
    plain = fit_regressions(df, KEYS, [model], "quarter").first()
    same = fit_arima(df, KEYS, [as_arima(model)], "quarter").first()
    assert same.orders == "ARIMA(0,0,0)(0,0,0)[4]" and same.n == plain.n
    for term, b in plain.coef.items():
        assert same.coef[term] == pytest.approx(b, abs=1e-9)
    assert same.sse == pytest.approx(plain.sse)


def test_regression_with_errors_beats_two_steps(spark):
    rng = np.random.default_rng(9)
    parts = []
    for i in range(20):
        n = 200
        e = rng.normal(size=n)
        u = np.zeros(n)
        for t in range(1, n):
            u[t] = 0.8 * u[t - 1] + e[t]
        x = np.cumsum(rng.normal(size=n)) * 0.3
        parts.append(table(n, {"y": 2 + 1.5 * x + u, "x": x}, key=str(i)))
    df = frame(spark, pd.concat(parts))
    spec = fixed("m", p=1, lags=(Lag("x", 0),))
    fits = fit_arima(df, KEYS, [spec], "quarter")
    rows = fits.toPandas()
    assert np.mean([dict(c)["x_lag0"] for c in rows["coef"]]) == pytest.approx(1.5, abs=0.1)
    assert np.mean([dict(c)["ar1"] for c in rows["coef"]]) == pytest.approx(0.8, abs=0.05)
    table_ = coefficient_table(fits, KEYS).toPandas()
    assert set(table_["term"]) == {"intercept", "x_lag0", "ar1"} and (table_["std_error"] > 0).all()


def brute_forecast(y, x_beta, phi, h, d, D, m):
    n = list(y - x_beta[: len(y)])
    poly = np.array([1.0, -phi])
    for step in [1] * d + [m] * D:
        poly = np.convolve(poly, [1.0] + [0.0] * (step - 1) + [-1.0])
    out = []
    for k in range(h):
        out.append(sum(-c * n[-i] for i, c in enumerate(poly) if i))
        n.append(out[-1])
    return np.array(out) + x_beta[len(y) :]


@pytest.mark.parametrize("d,D", [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0)])
def test_forecasts_match_the_recursion(spark, d, D):
    rng = np.random.default_rng(10 + d + 2 * D)
    n, h = 60, 6
    y = np.cumsum(rng.normal(size=n)) + np.arange(n) % 4
    df = frame(spark, table(n, {"y": y}))
    spec = fixed("m", p=1, d=d, D=D)
    fits = fit_arima(df, KEYS, [spec], "quarter")
    r = fits.first()
    coef = dict(r.coef)
    months = [(p.year - 1970) * 4 + (p.month - 1) // 3 for p in periods(n + h)]
    base = coef.get("intercept", 0.0) + coef.get("drift", 0.0) * np.array(months)
    future = future_frame(df, KEYS, "quarter", h)
    out = forecast_arima(df, future, fits, KEYS, [spec], "quarter").orderBy("h").toPandas()
    want = brute_forecast(y, base, coef["ar1"], h, d, D, 4)
    assert np.allclose(out["mean"], want) and list(out["period"]) == periods(n + h)[n:]
    assert (np.diff(out["sigma"]) > -1e-12).all()
    assert out["sigma"].iloc[0] == pytest.approx(np.sqrt(r.sigma2))


def test_moving_average_forecast_dies_out_and_residuals_are_shocks(spark, simulated):
    df = simulated["ma1"]
    spec = fixed("m", q=1)
    fits = fit_arima(df, KEYS, [spec], "quarter").cache()
    out = forecast_arima(df, future_frame(df, KEYS, "quarter", 4), fits, KEYS, [spec], "quarter")
    means = {r.key: dict(r.coef)["intercept"] for r in fits.collect()}
    for r in out.filter("h > 1").collect():
        assert r.mean == pytest.approx(means[r.key])
    left = arima_residuals(df, fits, KEYS, [spec], "quarter")
    sums = left.groupBy("key").agg(F.sum(F.col("residual") ** 2).alias("s"))
    sse = {r.key: r.sse for r in fits.collect()}
    assert all(r.s == pytest.approx(sse[r.key]) for r in sums.collect())


def test_two_stage_and_early_end_of_a_predictor(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=40)
    y = np.r_[0, x[:-1]] * 2
    x[-1] = np.nan
    df = frame(spark, table(40, {"y": y, "x": x}))
    spec = Arima("predictor", "value", 1, 0, 0, 0, 0, 0)
    ahead = forecast_predictors(df, KEYS, ["x"], "quarter", 3, spec).orderBy("period").toPandas()
    assert list(ahead["period"]) == periods(43)[39:]
    model = Regression("m", "y", lags=(Lag("x", 1),))
    fits = [fit_regressions(df, KEYS, [model], "quarter")]
    out = forecast_two_stage(
        df, KEYS, [model], fits, "quarter", 3, ["x"], predictor_spec=spec
    ).orderBy("h").toPandas()
    # the first step needs the missing last value of the predictor
    assert out["mean"].isna().tolist() == [True, False, False]
    assert np.allclose(out["mean"][1:], 2 * ahead["mean"][1:3], atol=1e-8)


def test_winner_per_key_is_refitted(spark):
    parts = [simulate({1: 0.9}, {}, 120, 3, 12, "ar"), simulate({}, {}, 120, 3, 13, "noise")]
    df = frame(spark, pd.concat(parts))
    models = [Regression("mean", "y"), fixed("ar", p=1)]
    board, fits = select_and_refit(df, KEYS, models, "quarter", 2024)
    first = {r.key: r.model for r in board.filter("rank = 1").collect()}
    got = {r.key: r.model for f in fits for r in f.select("key", "model").collect()}
    assert got == first and len(first) == 6
    ranks = aicc_leaderboard(fits[0].unionByName(fits[1], allowMissingColumns=True), KEYS)
    assert ranks.filter("rank > 1").count() == 0


def test_short_series_are_fitted_too(spark):
    rng = np.random.default_rng(14)
    data = pd.concat([table(n, {"y": rng.normal(size=n)}, key=str(n)) for n in (5, 9, 14, 40)])
    df = frame(spark, data)
    specs = [fixed("ar", p=1), fixed("big", p=1, q=1, P=1, Q=1), Arima("auto", "y", d=0, D=0)]
    fits = fit_arima(df, KEYS, specs, "quarter").toPandas()
    assert len(fits) == 12 and (fits["n"] == fits["key"].astype(int)).all()
    future = future_frame(df, KEYS, "quarter", 2)
    out = forecast_arima(df, future, fit_arima(df, KEYS, specs[:1], "quarter"), KEYS, specs[:1], "quarter")
    assert out.filter("mean is not null").count() == 8


def test_coinciding_lags_count_once(spark):
    """Quarterly and without products, lag 4 of p = 4 and lag 4 of P = 1 are one coefficient."""
    values = np.random.default_rng(4).normal(size=80)
    data = frame(spark, table(80, {"y": values}))
    specs = [Arima("plain", "y", 4, 0, 0, 0, 0, 0), Arima("both", "y", 4, 0, 0, 1, 0, 0, multiplicative=False)]
    plain, both = fit_arima(data, ["key"], specs, "quarter").orderBy(F.desc("model")).collect()
    assert plain["rank"] == both["rank"] == 6
    assert plain["aicc"] == pytest.approx(both["aicc"]) and plain["sigma2"] == pytest.approx(both["sigma2"])


# -- products of polynomials, missing periods, searches -----------------------------------


def brute_errors(y, mean, phi, sphi, theta, stheta, m):
    """One-step errors by the products written out; missing values are stood in for by their forecasts."""
    ar = -np.convolve([1, *(-np.asarray(phi))], np.ravel([[1.0] + [0.0] * (m - 1)] + [[-c] + [0.0] * (m - 1) for c in sphi])[: m * len(sphi) + 1])[1:]
    ma = np.convolve([1, *theta], np.ravel([[1.0] + [0.0] * (m - 1)] + [[c] + [0.0] * (m - 1) for c in stheta])[: m * len(stheta) + 1])[1:]
    u, e = np.zeros(len(y)), np.zeros(len(y))
    for t in range(len(y)):
        guess = sum(c * u[t - i - 1] for i, c in enumerate(ar) if t > i) + sum(c * e[t - j - 1] for j, c in enumerate(ma) if t > j)
        u[t] = guess if np.isnan(y[t]) else y[t] - mean
        e[t] = 0.0 if np.isnan(y[t]) else u[t] - guess
    return u, e


def with_holes(values, r, share=0.1):
    out = np.array(values, float)
    out[1 + r.choice(len(out) - 2, int(share * len(out)), replace=False)] = np.nan
    return out


@pytest.mark.parametrize("orders", [(1, 0, 1, 0), (0, 1, 0, 1), (2, 1, 1, 1), (1, 1, 2, 0)])
def test_recursion_and_derivatives_with_missing_values(orders):
    p, q, P, Q = orders
    r = np.random.default_rng(sum(orders))
    shape, m = arma.Shape(orders, 4, True), 4
    y = np.stack([with_holes(r.normal(size=50), r) for _ in range(3)])
    seen, x = ~np.isnan(y), r.normal(size=(3, 50, 2))
    coef, beta = r.uniform(-0.5, 0.5, (3, shape.size)), r.normal(size=(3, 2))

    def errors(beta, coef, dv=None):
        v = np.where(seen, np.nan_to_num(y) - np.einsum("btk,bk->bt", x, beta), 0.0)
        return arma.recursion(v, seen, *shape.polynomials(coef), dv, shape, coef)

    _, e, slope = errors(beta, coef, -x)
    for i in range(3):
        parts = [c[i] for c in shape.split(coef)]
        want = brute_errors(y[i] - x[i] @ beta[i], 0.0, parts[0], parts[1], parts[2], parts[3], m)[1]
        assert np.allclose(e[i], want)
    for j in range(2 + shape.size):
        step = np.zeros(2 + shape.size)
        step[j] = 1e-6
        near = [errors(beta + s * step[:2], coef + s * step[2:])[1] for s in (1, -1)]
        assert np.allclose((near[0] - near[1]) / 2e-6, slope[:, :, j], atol=1e-6)


def test_multiplied_polynomials_are_recovered(spark):
    data = frame(spark, simulate({1: 0.5, 4: 0.6, 5: -0.3}, {}, 500, 30, 21, "p"))
    fits = fit_arima(data, KEYS, [fixed("m", p=1, P=1)], "quarter").toPandas()
    assert fits["converged"].all() and (fits["rank"] == 4).all()
    for term, value in (("ar1", 0.5), ("sar1", 0.6)):
        assert np.mean([dict(c)[term] for c in fits["coef"]]) == pytest.approx(value, abs=0.03)
    for row in fits.itertuples():
        assert row.ar[4] == pytest.approx(-row.ar[0] * row.ar[3])
    shocks = frame(spark, simulate({}, {1: 0.4, 4: 0.5, 5: 0.2}, 500, 30, 22, "q"))
    fits = fit_arima(shocks, KEYS, [fixed("m", q=1, Q=1)], "quarter").toPandas()
    for term, value in (("ma1", 0.4), ("sma1", 0.5)):
        assert np.mean([dict(c)[term] for c in fits["coef"]]) == pytest.approx(value, abs=0.03)


def test_estimates_are_least_squares_with_regressors_and_gaps(spark):
    """No small step from the estimate lowers the sum of squares written out by hand."""
    r = np.random.default_rng(23)
    x = r.normal(size=90).cumsum() * 0.2
    y = with_holes(2 + 1.5 * x + simulate({1: 0.5, 4: 0.4, 5: -0.2}, {1: 0.3}, 90, 1, 24, "s")["y"].to_numpy(), r)
    df = frame(spark, table(90, {"y": y, "x": x})).filter("y IS NOT NULL")
    fit = fit_arima(df, KEYS, [fixed("m", p=1, P=1, q=1, lags=(Lag("x", 0),))], "quarter").first()
    assert fit.converged and fit.n == np.isfinite(y).sum()
    start = np.array([fit.coef[t] for t in ("intercept", "x_lag0", "ar1", "sar1", "ma1")])

    def total(c):
        return (brute_errors(y - c[1] * x, c[0], c[2:3], c[3:4], c[4:], [], 4)[1] ** 2).sum()

    assert total(start) == pytest.approx(fit.sse)
    for i in range(5):
        for step in (1e-3, -1e-3):
            moved = start.copy()
            moved[i] += step
            assert total(moved) > fit.sse


def test_six_gaps_change_a_seasonal_estimate_little(spark):
    whole = simulate({4: 0.8}, {}, 160, 20, 25, "g")
    dates = set(sorted(whole["period"].unique())[i] for i in (20, 41, 42, 77, 110, 139))
    full = fit_arima(frame(spark, whole), KEYS, [fixed("m", P=1)], "quarter").toPandas()
    parts = fit_arima(frame(spark, whole[~whole["period"].isin(dates)]), KEYS, [fixed("m", P=1)], "quarter").toPandas()
    a, b = ({k: dict(c)["sar1"] for k, c in zip(t["key"], t["coef"])} for t in (full, parts))
    assert np.mean([abs(a[k] - b[k]) for k in a]) < 0.03 and (parts["n"] == 154).all()


@pytest.mark.parametrize("d,D", [(0, 0), (1, 0), (0, 1)])
def test_missing_end_keeps_the_origin(spark, d, D):
    """Null values at the end do not move the origin: forecasts go on from it and intervals widen."""
    r = np.random.default_rng(26)
    y = r.normal(size=60).cumsum() + np.arange(60) % 4
    y[[20, 33]] = np.nan
    late = y.copy()
    late[-2:] = np.nan
    spec = fixed("m", p=1, d=d, D=D)
    df = frame(spark, table(60, {"y": y}))
    fits = fit_arima(df, KEYS, [spec], "quarter")
    ahead = {}
    for name, values in (("late", late), ("early", y[:-2])):
        past = frame(spark, table(len(values), {"y": values}))
        out = forecast_arima(past, future_frame(past, KEYS, "quarter", 6), fits, KEYS, [spec], "quarter")
        ahead[name] = {x.period: (x.mean, x.sigma) for x in out.collect()}
    assert sorted(ahead["late"]) == periods(66)[60:]
    for period in periods(64)[60:]:
        assert ahead["late"][period][0] == pytest.approx(ahead["early"][period][0])
    assert ahead["late"][periods(61)[60]][1] == pytest.approx(ahead["early"][periods(59)[58]][1])


def test_gaps_equal_explicit_nulls_and_residuals_skip_them(spark):
    r = np.random.default_rng(27)
    data = table(80, {"y": with_holes(r.normal(size=80).cumsum(), r)})
    spec = fixed("m", p=1, q=1, P=1)
    fits = [fit_arima(frame(spark, t), KEYS, [spec], "quarter") for t in (data, data.dropna())]
    a, b = (f.first() for f in fits)
    assert a.params == pytest.approx(b.params) and a.n == b.n == data["y"].notna().sum()
    left = arima_residuals(frame(spark, data.dropna()), fits[1], KEYS, [spec], "quarter")
    assert left.count() == b.n and left.agg(F.sum(F.col("residual") ** 2)).first()[0] == pytest.approx(b.sse)


def test_full_search_equals_every_fit(spark):
    """The winner of the bounded search is the least AICc over separate joint fits of all orders."""
    data = frame(spark, simulate({1: 0.5}, {1: 0.4, 4: 0.4}, 120, 6, 28, "f"))
    grid = Arima("grid", "y", (0, 2), 0, (0, 1), 0, 0, (0, 1))
    found = fit_arima(data, KEYS, [grid], "quarter", approximation=False).toPandas().set_index("key")
    singles = [fixed(f"o{p}{q}{Q}", p=p, q=q, Q=Q) for p in range(3) for q in range(2) for Q in range(2)]
    every = fit_arima(data, KEYS, singles, "quarter").toPandas()
    every = every[every["converged"]]
    best = every.sort_values("aicc").groupby("key").first()
    for key, row in found.iterrows():
        assert row.aicc <= best.loc[key, "aicc"] + 1e-6
    assert (found["tried"] <= 12).all() and found["tried"].sum() < 12 * 6


def test_search_memory_does_not_grow_with_the_orders():
    """Per series the best order so far is kept: 139 orders take no more memory than a few."""
    import tracemalloc

    orders = Arima("a", "y").orders()
    assert len(orders) == 139
    r = np.random.default_rng(29)
    y = r.normal(size=(10_000, 60))
    seen, x, beta = np.ones(y.shape, bool), np.ones((10_000, 60, 1)), y.mean(axis=1)[:, None]
    peak = []
    longest = [o for o in orders if o in ((5, 1, 0, 0), (1, 5, 0, 0), (0, 0, 2, 2), (2, 2, 1, 1))]
    for some in (longest, orders):
        tracemalloc.start()
        at, coef, _ = arma.search(y, x, seen, beta, np.ones(10_000), some, 4, True)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(at) == 10_000 and coef.shape[1] == max(sum(o) for o in some)
    assert peak[1] < 1.3 * peak[0]


def test_constant_is_left_to_the_search(spark):
    r = np.random.default_rng(30)
    data = pd.concat([table(120, {"y": r.normal(size=120) + (8 if i % 2 else 0)}, key=str(i)) for i in range(8)])
    df = frame(spark, data)
    specs = [fixed("free", p=1, intercept=None), fixed("yes", p=1), fixed("no", p=1, intercept=False)]
    fits = fit_arima(df, KEYS, specs, "quarter").toPandas().set_index(["key", "model"])
    for key in data["key"].unique():
        pair = {True: fits.loc[(key, "yes")], False: fits.loc[(key, "no")]}
        free = fits.loc[(key, "free")]
        assert free.aicc == pytest.approx(min(p.aicc for p in pair.values()))
        assert ("intercept" in dict(free.coef)) == free.constant == (pair[True].aicc < pair[False].aicc)
        assert free.constant or int(key) % 2 == 0
    ahead = forecast_arima(df, future_frame(df, KEYS, "quarter", 3), fit_arima(df, KEYS, specs[:1], "quarter"), KEYS, specs[:1], "quarter")
    assert ahead.count() == 24 and ahead.filter("mean IS NULL").count() == 0


def test_keys_without_complete_rows_have_no_fit(spark):
    data = pd.concat([table(30, {"y": np.random.default_rng(31).normal(size=30)}), table(30, {"y": np.full(30, np.nan)}, key="none")])
    df = frame(spark, data)
    fits = fit_arima(df, KEYS, [fixed("m", p=1)], "quarter")
    assert [r.key for r in fits.collect()] == ["a"]
    empty = df.limit(0)
    assert fit_arima(empty, KEYS, [fixed("m", p=1)], "quarter").count() == 0


def peak_of(function, batches):
    """The results of a function over batches, and the MB that it held at most beside its input."""
    import tracemalloc

    tracemalloc.start()
    parts, most = [], 0
    for part in function(batches):
        most = max(most, tracemalloc.get_traced_memory()[1])
        # a worker sends each part away before it asks for the next
        tracemalloc.stop()
        parts.append(part.copy())
        tracemalloc.start()
    tracemalloc.stop()
    return pd.concat(parts, ignore_index=True), most / 1e6


def test_solvers_hold_a_slice_not_a_batch(spark):
    """A batch of 6,000 series: memory within a bound, the same fits as for small batches (F1)."""
    from tspanel.operators.arima import _Means, _solver
    from tspanel.operators.design import Design
    from tspanel.operators.regression import profiles, solver

    size, n, specs = 6000, 84, [Arima("lm_ar", "y", 1, 0, 0, 0, 0, 0, lags=(Lag("x"),), season=True)]
    shapes = list(_Means(specs).models.values())
    design = Design(shapes, "month")
    terms, name = design.terms[shapes[0].name], shapes[0].name
    k, rng = len(terms.all), np.random.default_rng(5)
    cells = np.tile(np.arange(n, dtype=np.int32) % 12, (size, 1))
    dense = rng.normal(size=(size, 2 * n))
    dense[rng.random(dense.shape) < 0.02] = np.nan
    calls = {
        "arima": (
            _solver(design, specs, 12, None, 0, False),
            ["lm_ar"] * size, [name] * size, [k] * size, list(cells), list(dense), list(rng.normal(size=(size, k))),
        ),
        "regression": (
            solver(design),
            [name] * size, list(cells[:, :12]), list(np.full((size, 12), 7)), list(rng.normal(size=(size, 24))),
            list(np.tile([80.0, 3.0, 90.0], (size, 1))), list(np.zeros((size, 2))),
        ),
        "profiles": (
            profiles(design, False),
            [name] * size, list(rng.normal(size=(size, k))), list(rng.normal(size=(size, k * k))),
        ),
    }
    for what, (function, *columns) in calls.items():
        columns = tuple(pd.Series(c) for c in columns)
        got, peak = peak_of(function.func, iter([columns]))
        assert len(got) == size and peak < 40, (what, peak)
        small = [tuple(c.iloc[i : i + 7].reset_index(drop=True) for c in columns) for i in range(0, 700, 7)]
        want = pd.concat(function.func(iter(small)), ignore_index=True)
        for column in got.columns:
            for a, b in zip(got[column].head(700), want[column]):
                assert np.allclose(np.asarray(a, float), np.asarray(b, float), equal_nan=True), (what, column)
