"""Forecasts, scores and the choice of a winner on the supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tspanel.operators.arima import fit_arima, forecast_arima
from tspanel.operators.forecast import LEVELS, forecast_regressions
from tspanel.operators.panel import future_frame, future_predictors, melt
from tspanel.operators.regression import fit_regressions
from tspanel.operators.score import accuracy, rmse_leaderboard, scaled_accuracy
from tspanel.operators.spec import Arima
from tspanel.operators.tables import history_with_forecast as history_and_forecast
from tspanel.operators.transform import after_year, until_year
from tspanel.plans.compare import (
    fit_models,
    forecast_models,
    forecast_two_stage as two_stage,
    holdout_scores,
    select_and_refit as choose,
)
from tspanel.session import stage

from .least_squares import ar1_sql
from .models import (
    AR_1,
    CALENDAR,
    CUT,
    KEYS,
    LAGGED,
    LM_1,
    LM_2,
    LM_AR_1,
    regression_sql,
    train,
)
from .registry import SUPPLY_GROWTH, R, query, rounded, supply_growth

INTERVALS = ["mean", "sigma", "lo80", "hi80", "lo95", "hi95"]


def bounds_sql(mean: str, sigma: str, digits: int = 4) -> str:
    parts = [f"{R(mean, digits)} AS mean", f"{R(sigma, digits)} AS sigma"]
    for level, z in LEVELS.items():
        parts.append(f"{R(f'{mean} - {z} * {sigma}', digits)} AS lo{level}")
        parts.append(f"{R(f'{mean} + {z} * {sigma}', digits)} AS hi{level}")
    return ", ".join(parts)


def holdout(spark, folder, models):
    data = stage(supply_growth(spark, folder))
    past, ahead = until_year(data, CUT), after_year(data, CUT)
    fits = fit_regressions(past, KEYS, models, "month")
    return forecast_regressions(past, ahead, fits, KEYS, models, "month")


HOLDOUT = f"""WITH {LAGGED}, {regression_sql('lm_1')}, {regression_sql('lm_2', two=True)},
fc AS (
  SELECT g.key, 'lm_1' AS model, g.period, g.y AS actual, s.level + b.b1 * g.x1 AS mean,
    sqrt(b.sigma2 * (1 + 1.0 / s.n_s + pow(g.x1 - s.m1, 2) / b.a)) AS sigma
  FROM lagged g JOIN lm_1 b USING (key)
  LEFT JOIN lm_1_s s ON s.key = g.key AND s.s = month(g.period) WHERE NOT is_train
  UNION ALL
  SELECT g.key, 'lm_2', g.period, g.y, s.level + b.b1 * g.x1 + b.b2 * g.x2, NULL
  FROM lagged g JOIN lm_2 b USING (key)
  LEFT JOIN lm_2_s s ON s.key = g.key AND s.s = month(g.period) WHERE NOT is_train)"""


@query(
    HOLDOUT
    + f"""
SELECT key, model, period, row_number() OVER (PARTITION BY key, model ORDER BY period)::INTEGER
  AS h, {R('actual', 4)} AS actual, {R('mean', 4)} AS mean FROM fc"""
)
def forecast_holdout(spark, folder):
    out = holdout(spark, folder, [LM_1, LM_2])
    return rounded(out.select("key", "model", "period", "h", "actual", "mean"), ["actual", "mean"], 4)


@query(
    HOLDOUT
    + f""" SELECT key, model, period, {bounds_sql('mean', 'sigma')} FROM fc WHERE model = 'lm_1'"""
)
def forecast_intervals_regression(spark, folder):
    out = holdout(spark, folder, [LM_1])
    return rounded(out.select("key", "model", "period", *INTERVALS), INTERVALS, 4)


SCORES = HOLDOUT + """,
e AS (SELECT key, model, period, actual, actual - mean AS e,
    actual - mean - avg(actual - mean) OVER (PARTITION BY key, model) AS o
  FROM fc WHERE actual - mean IS NOT NULL),
l AS (SELECT *, lag(o) OVER (PARTITION BY key, model ORDER BY period) AS o1,
    e / nullif(actual, 0) * 100 AS pe FROM e),
scores AS (SELECT key, model, count(*) AS n, avg(e) AS me, sqrt(avg(e * e)) AS rmse,
    avg(abs(e)) AS mae, avg(pe) AS mpe, avg(abs(pe)) AS mape,
    sum(o * o1) / sum(o * o) AS acf1 FROM l GROUP BY 1, 2)"""
MEASURES = ["me", "rmse", "mae", "mpe", "mape", "acf1"]


@query(
    SCORES + " SELECT key, model, n, " + ", ".join(f"{R(m, 4)} AS {m}" for m in MEASURES) + " FROM scores",
    name="accuracy",
)
def scores(spark, folder):
    return rounded(accuracy(holdout(spark, folder, [LM_1, LM_2]), KEYS), MEASURES, 4)


@query(
    SCORES
    + f"""
, d AS (SELECT key, period, y - lag(y, 12) OVER (PARTITION BY key ORDER BY period) AS d
  FROM lagged WHERE is_train),
c AS (SELECT key, avg(abs(d)) AS s1, sqrt(avg(d * d)) AS s2 FROM d GROUP BY 1)
SELECT key, model, {R('mae / s1')} AS mase, {R('rmse / s2')} AS rmsse FROM scores JOIN c USING (key)"""
)
def accuracy_scaled(spark, folder):
    board = accuracy(holdout(spark, folder, [LM_1, LM_2]), KEYS)
    out = scaled_accuracy(board, train(spark, folder), KEYS, "revenue", "month")
    return rounded(out.select("key", "model", "mase", "rmsse"), ["mase", "rmsse"])


@query(
    SCORES
    + f"""
SELECT key, model, {R('rmse', 4)} AS rmse,
  row_number() OVER (PARTITION BY key ORDER BY rmse, model)::INTEGER AS rank FROM scores""",
    name="rmse_leaderboard",
)
def rmse_ranks(spark, folder):
    board = accuracy(holdout(spark, folder, [LM_1, LM_2]), KEYS)
    return rounded(rmse_leaderboard(board, KEYS), ["rmse"], 4)


@query(
    HOLDOUT
    + f"""
SELECT key, 'history' AS kind, NULL::VARCHAR AS model, period, {R('y', 4)} AS value,
  NULL::DOUBLE AS lo80, NULL::DOUBLE AS hi80, NULL::DOUBLE AS lo95, NULL::DOUBLE AS hi95
FROM lagged WHERE is_train
UNION ALL SELECT key, 'forecast', model, period, mean, lo80, hi80, lo95, hi95
FROM (SELECT key, model, period, {bounds_sql('mean', 'sigma')} FROM fc WHERE model = 'lm_1')"""
)
def history_with_forecast(spark, folder):
    out = history_and_forecast(
        train(spark, folder), holdout(spark, folder, [LM_1]), KEYS, "revenue"
    )
    return rounded(out, ["value", "lo80", "hi80", "lo95", "hi95"], 4)


# -- out of sample --------------------------------------------------------------------

EVERY = f"{LAGGED}, {regression_sql('lm_1', where='true')}"
AHEAD = """
last AS (SELECT key, max(period) AS hi FROM growth GROUP BY 1),
steps AS (SELECT key, h::INTEGER AS h, (hi + to_months(h::INTEGER))::DATE AS period
  FROM last, generate_series(1, 12) AS g(h))"""


@query(
    f"""WITH {EVERY}, {AHEAD},
f AS (SELECT s.key, s.h, s.period, g.quantity FROM steps s
  LEFT JOIN growth g ON g.key = s.key AND g.period = (s.period - INTERVAL 1 YEAR)::DATE),
o AS (SELECT key, 0 AS h, period, quantity FROM growth UNION ALL SELECT * FROM f),
x AS (SELECT key, h, period, lag(quantity, 1) OVER (PARTITION BY key ORDER BY period) AS x FROM o),
fc AS (SELECT x.key, x.h, x.period, s.level + b.b1 * x.x AS mean,
    sqrt(b.sigma2 * (1 + 1.0 / s.n_s + pow(x.x - s.m1, 2) / b.a)) AS sigma
  FROM x JOIN lm_1 b USING (key)
  LEFT JOIN lm_1_s s ON s.key = x.key AND s.s = month(x.period) WHERE h > 0)
SELECT key, 'lm_1' AS model, period, h, {bounds_sql('mean', 'sigma')} FROM fc"""
)
def forecast_future(spark, folder):
    """Twelve months ahead; the predictor takes its values of the year before."""
    data = stage(supply_growth(spark, folder))
    naive = melt(data, ["key", "period"], ["quantity"]).select(
        "key", "series", F.add_months("period", 12).alias("period"), F.col("value").alias("mean")
    )
    future = future_predictors(
        future_frame(data, KEYS, "month", 12), naive, KEYS, ["quantity"]
    )
    fits = fit_regressions(data, KEYS, [LM_1], "month")
    out = forecast_regressions(data, future, fits, KEYS, [LM_1], "month")
    return rounded(out.select("key", "model", "period", "h", *INTERVALS), INTERVALS, 4)


def ar_forecast_sql(value: str) -> str:
    """CTEs ``ar`` (least squares per key) and ``ar_fc`` (12 steps ahead)."""
    return f"""{ar1_sql('ar', f'SELECT key, period, {value} AS y FROM growth')},
ar_fc AS (SELECT s.key, s.h, s.period, mu + pow(phi, h) * u_last AS mean,
    sqrt(sse / (n - 2) * (1 - pow(phi, 2 * h)) / (1 - phi * phi)) AS sigma
  FROM steps s JOIN ar USING (key))"""


@query(
    f"""WITH {SUPPLY_GROWTH}, {AHEAD}, {ar_forecast_sql('revenue')}
SELECT key, 'ar_1' AS model, period, h, {R('mean', 4)} AS mean FROM ar_fc"""
)
def forecast_h(spark, folder):
    return _ar_ahead(spark, folder).select("key", "model", "period", "h", "mean")


@query(
    f"""WITH {SUPPLY_GROWTH}, {AHEAD}, {ar_forecast_sql('revenue')}
SELECT key, 'ar_1' AS model, period, h, {bounds_sql('mean', 'sigma')} FROM ar_fc"""
)
def forecast_intervals(spark, folder):
    return _ar_ahead(spark, folder).select("key", "model", "period", "h", *INTERVALS)


def _ar_ahead(spark, folder):
    data = stage(supply_growth(spark, folder))
    fits = fit_arima(data, KEYS, [AR_1], "month")
    future = future_frame(data, KEYS, "month", 12)
    out = forecast_arima(data, future.select("key", "period"), fits, KEYS, [AR_1], "month")
    return rounded(out, INTERVALS, 4)


@query(
    f"""WITH {EVERY}, {AHEAD}, {ar_forecast_sql('quantity')},
o AS (SELECT key, 0 AS h, period, quantity FROM growth
  UNION ALL SELECT key, h, period, mean FROM ar_fc),
x AS (SELECT key, h, period, lag(quantity, 1) OVER (PARTITION BY key ORDER BY period) AS x FROM o)
SELECT x.key, 'lm_1' AS model, x.period, x.h, {R('s.level + b.b1 * x.x', 4)} AS mean
FROM x JOIN lm_1 b USING (key) LEFT JOIN lm_1_s s ON s.key = x.key AND s.s = month(x.period)
WHERE h > 0"""
)
def forecast_two_stage(spark, folder):
    """The predictor follows a first-order autoregression, the target the predictor."""
    data = stage(supply_growth(spark, folder))
    fits = fit_models(data, KEYS, [LM_1], "month")
    spec = Arima("predictor", "value", 1, 0, 0, 0, 0, 0)
    out = two_stage(data, KEYS, [LM_1], fits, "month", 12, ["quantity"], predictor_spec=spec)
    return rounded(out.select("key", "model", "period", "h", "mean"), ["mean"], 4)


@query(
    SCORES
    + f""",
{regression_sql('all_1', where='true')}, {regression_sql('all_2', two=True, where='true')},
w AS (SELECT key, model, rmse, row_number() OVER (PARTITION BY key ORDER BY rmse, model) AS place
  FROM scores)
SELECT w.key, w.model, {R('w.rmse', 4)} AS rmse, coalesce(a.n, b.n) AS n,
  {R('coalesce(a.b1, b.b1)', 5)} AS b1, {R('coalesce(a.aicc, b.aicc)', 5)} AS aicc
FROM w LEFT JOIN all_1 a ON a.key = w.key AND w.model = 'lm_1'
LEFT JOIN all_2 b ON b.key = w.key AND w.model = 'lm_2' WHERE place = 1""",
)
def select_and_refit(spark, folder):
    """The model with the least hold-out error of each supplier, fitted on all its data."""
    board, (fits,) = choose(supply_growth(spark, folder), KEYS, [LM_1, LM_2], "month", CUT)
    out = fits.join(board.filter("rank = 1").select("key", "model", "rmse"), ["key", "model"])
    out = out.select(
        "key", "model", F.round("rmse", 4).alias("rmse"), "n",
        F.col("coef")["quantity_lag1"].alias("b1"), "aicc",
    )
    return rounded(out, ["b1", "aicc"], 5)


# -- families: a regression, the same with autoregressive errors, an autoregression ---

FAMILIES = [LM_1, LM_AR_1, AR_1]


def families_sql(name: str, where: str) -> str:
    """CTEs ``<name>_e`` and ``<name>_u``: two-step first-order error processes per key.

    ``_e`` belongs to the residuals of the regression ``<name>`` (lags on the calendar), ``_u`` to the
    centred target; ``<name>_o`` has the last month of the history.
    """

    def process(out: str, rows: str, params: str) -> str:
        return f"""
{out}_l AS (SELECT key, period, u, lag(u) OVER w AS u1, datediff('month', lag(period) OVER w, period) AS g,
    row_number() OVER (PARTITION BY key ORDER BY period DESC) AS back FROM ({rows})
  WINDOW w AS (PARTITION BY key ORDER BY period)),
{out}_p AS (SELECT key, sum(u * u1) / sum(u1 * u1) AS phi FROM {out}_l WHERE g = 1 GROUP BY 1),
{out} AS (SELECT key, any_value(phi) AS phi,
    -- the last deviation, carried to the last month of the history
    max(CASE WHEN back = 1 THEN u * pow(phi, datediff('month', period, origin)) END) AS u_last,
    sum(pow(u - coalesce(pow(phi, g) * u1, 0), 2)) / (count(*) - any_value({params})) AS sigma2
  FROM {out}_l JOIN {out}_p USING (key) JOIN {name}_b USING (key) JOIN {name}_o USING (key) GROUP BY 1)"""

    left = f"""SELECT r.key, r.period, r.y - s.level - b.b1 * r.x1 AS u FROM {name}_r r
      JOIN {name}_b b USING (key) JOIN {name}_s s ON s.key = r.key AND s.s = r.s"""
    centred = f"""SELECT key, period, y - avg(y) OVER (PARTITION BY key) AS u
      FROM lagged WHERE {where}"""
    return f"""
{name}_mu AS (SELECT key, avg(y) AS mu FROM lagged WHERE {where} GROUP BY 1),
{name}_o AS (SELECT key, max(period) AS origin FROM lagged WHERE {where} GROUP BY 1),
{process(f"{name}_e", left, "rank + 1")},
{process(f"{name}_u", centred, "2")}"""


def sigma_ar(sigma2: str, phi: str, h: str) -> str:
    return f"sqrt({sigma2} * (1 - pow({phi}, 2 * {h})) / (1 - {phi} * {phi}))"


THREE_AHEAD = f"""WITH {LAGGED}, {CALENDAR}, {regression_sql('lm_1')}, {regression_sql('cal_1', rows='on_calendar')},
{families_sql('cal_1', 'is_train')},
t AS (SELECT l.key, l.period, l.y, l.x1, c.x1 AS xc, row_number() OVER (PARTITION BY l.key ORDER BY l.period) AS h,
    datediff('month', origin, l.period) AS steps
  FROM lagged l JOIN on_calendar c ON c.key = l.key AND c.period = l.period JOIN cal_1_o o ON o.key = l.key
  WHERE NOT l.is_train),
fc AS (
  SELECT 'lm_1' AS model, t.key, t.period, t.h, t.y AS actual, s.level + b.b1 * t.x1 AS mean,
    sqrt(b.sigma2 * (1 + 1.0 / s.n_s + pow(t.x1 - s.m1, 2) / b.a)) AS sigma
  FROM t JOIN lm_1 b USING (key) LEFT JOIN lm_1_s s ON s.key = t.key AND s.s = month(t.period)
  UNION ALL SELECT 'lm_ar_1', t.key, t.period, t.h, t.y, s.level + b.b1 * t.xc + pow(e.phi, steps) * e.u_last,
    {sigma_ar('e.sigma2', 'e.phi', 'steps')}
  FROM t JOIN cal_1 b USING (key) JOIN cal_1_e e ON e.key = t.key
  LEFT JOIN cal_1_s s ON s.key = t.key AND s.s = month(t.period)
  UNION ALL SELECT 'ar_1', t.key, t.period, t.h, t.y, mu + pow(phi, steps) * u_last,
    {sigma_ar('u.sigma2', 'phi', 'steps')}
  FROM t JOIN cal_1_u u USING (key) JOIN cal_1_mu m USING (key))"""


@query(
    THREE_AHEAD
    + f"""
SELECT key, model, period, h::INTEGER AS h, {R('actual', 4)} AS actual, {bounds_sql('mean', 'sigma')}
FROM fc WHERE model = 'lm_ar_1'"""
)
def arima_errors_holdout(spark, folder):
    """Hold-out forecasts of a regression with autoregressive errors."""
    data = stage(supply_growth(spark, folder))
    past, ahead = until_year(data, CUT), after_year(data, CUT)
    fits = fit_arima(past, KEYS, [LM_AR_1], "month", refine=0)
    out = forecast_arima(past, ahead, fits, KEYS, [LM_AR_1], "month")
    return rounded(out, ["actual", *INTERVALS], 4)


FAMILY_SCORES = THREE_AHEAD + """,
scores AS (SELECT key, model, count(*) AS n, avg(actual - mean) AS me,
    sqrt(avg(pow(actual - mean, 2))) AS rmse, avg(abs(actual - mean)) AS mae
  FROM fc WHERE actual - mean IS NOT NULL GROUP BY 1, 2)"""


@query(
    FAMILY_SCORES
    + f""" SELECT key, model, n, {R('me', 4)} AS me, {R('rmse', 4)} AS rmse, {R('mae', 4)} AS mae
FROM scores"""
)
def compare_families(spark, folder):
    """One model per family on the hold-out."""
    data = stage(supply_growth(spark, folder))
    out = holdout_scores(data, KEYS, FAMILIES, "month", CUT, refine=0)
    return rounded(out.drop("mpe", "mape", "acf1"), ["me", "rmse", "mae"], 4)


@query(
    FAMILY_SCORES
    + f""",
{regression_sql('all_1', where='true')}, {regression_sql('every', where='true', rows='on_calendar')},
{families_sql('every', 'true')},
w AS (SELECT key, model, row_number() OVER (PARTITION BY key ORDER BY rmse, model) AS place
  FROM scores),
n AS (SELECT key, (max(period) + INTERVAL 1 MONTH)::DATE AS period,
    arg_max(quantity, period) AS x FROM growth GROUP BY 1),
f AS (SELECT n.key, n.period, s.level + b.b1 * n.x AS lm, cs.level + cb.b1 * n.x AS lm_cal, e.phi AS e_phi,
    e.u_last AS e_last, u.phi AS u_phi, u.u_last AS u_last, m.mu,
    sqrt(b.sigma2 * (1 + 1.0 / s.n_s + pow(n.x - s.m1, 2) / b.a)) AS s_lm,
    sqrt(e.sigma2) AS s_e, sqrt(u.sigma2) AS s_u
  FROM n JOIN all_1 b USING (key) JOIN every cb USING (key) JOIN every_e e USING (key) JOIN every_u u USING (key)
  JOIN every_mu m USING (key) LEFT JOIN all_1_s s ON s.key = n.key AND s.s = month(n.period)
  LEFT JOIN every_s cs ON cs.key = n.key AND cs.s = month(n.period)),
o AS (SELECT f.key, w.model, f.period,
    CASE w.model WHEN 'lm_1' THEN lm WHEN 'lm_ar_1' THEN lm_cal + e_phi * e_last
      ELSE mu + u_phi * u_last END AS mean,
    CASE w.model WHEN 'lm_1' THEN s_lm WHEN 'lm_ar_1' THEN s_e ELSE s_u END AS sigma
  FROM f JOIN w ON w.key = f.key AND w.place = 1)
SELECT key, model, period, 1::INTEGER AS h, {bounds_sql('mean', 'sigma')} FROM o"""
)
def select_among_families(spark, folder):
    """Choose per key among the families, refit on all data, forecast a month."""
    data = stage(supply_growth(spark, folder))
    _, fits = choose(data, KEYS, FAMILIES, "month", CUT, best_per_family=True, refine=0)
    future = future_frame(data, KEYS, "month", 1).select("key", "period")
    out = forecast_models(data, future, fits, KEYS, FAMILIES, "month")
    return rounded(out.select("key", "model", "period", "h", *INTERVALS), INTERVALS, 4)


@query(
    f"""WITH {SUPPLY_GROWTH}, {AHEAD},
w AS (SELECT key, period, revenue AS y, CASE WHEN datediff('month', lag(period) OVER k, period) = 1
    THEN revenue - lag(revenue) OVER k END AS w FROM growth
  WINDOW k AS (PARTITION BY key ORDER BY period)),
{ar1_sql('p', 'SELECT key, period, w AS y FROM w')},
m AS (SELECT key, arg_max(y, period) AS y_last FROM w GROUP BY 1),
f AS (SELECT s.key, s.period, s.h,
    sum(mu + pow(phi, s.h) * u_last) OVER k + y_last AS mean,
    sqrt(sse / (n - 2) * sum(pow((1 - pow(phi, s.h)) / (1 - phi), 2)) OVER k) AS sigma
  FROM steps s JOIN p USING (key) JOIN m USING (key) WINDOW k AS (PARTITION BY s.key ORDER BY s.h))
SELECT key, 'ari' AS model, period, h, {bounds_sql('mean', 'sigma', 3)} FROM f"""
)
def forecast_differenced(spark, folder):
    """A first-order autoregression of the differences, with drift, back in levels."""
    spec = Arima("ari", "revenue", 1, 1, 0, 0, 0, 0)
    data = stage(supply_growth(spark, folder).select("key", "period", "revenue"))
    fits = fit_arima(data, KEYS, [spec], "month")
    future = future_frame(data, KEYS, "month", 12).select("key", "period")
    out = forecast_arima(data, future, fits, KEYS, [spec], "month")
    return rounded(out.select("key", "model", "period", "h", *INTERVALS), INTERVALS, 3)
