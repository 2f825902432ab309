"""Description: stationarity, correlations, seasons, decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tspanel.operators.describe import (
    KPSS_TABLE,
    autocorrelation,
    correlation_table,
    cross_correlation,
    kpss,
    seasonal_strength,
    seasonal_subseries,
    stl,
)
from tspanel.operators.panel import melt

from .registry import (
    ORDERS_GROWTH,
    SUPPLY_GROWTH,
    SUPPLY_MONTHLY,
    R,
    orders_growth,
    query,
    rounded,
    supply_growth,
    supply_monthly,
)

_STEPS = list(zip(KPSS_TABLE, KPSS_TABLE[1:]))
_P_VALUE = "CASE WHEN stat <= {0} THEN {1} ".format(*KPSS_TABLE[0]) + " ".join(
    f"WHEN stat <= {x1} THEN {p0} + (stat - {x0}) * ({p1} - {p0}) / ({x1} - {x0})"
    for (x0, p0), (x1, p1) in _STEPS
) + f" WHEN stat IS NOT NULL THEN {KPSS_TABLE[-1][1]} END"


@query(
    f"""WITH {SUPPLY_GROWTH}, long AS (
  SELECT key, 'revenue' AS series, period, revenue AS y FROM growth
  UNION ALL SELECT key, 'quantity', period, quantity FROM growth),
e AS (SELECT key, series, period, y - avg(y) OVER k AS e, count(y) OVER k AS n,
    row_number() OVER (PARTITION BY key, series ORDER BY period) AS i
  FROM long WHERE y IS NOT NULL WINDOW k AS (PARTITION BY key, series)),
s AS (SELECT *, sum(e) OVER (PARTITION BY key, series ORDER BY period) AS s,
    floor(4 * pow(n / 100.0, 0.25)) AS l FROM e),
g AS (SELECT a.key, a.series, sum((1 - (a.i - b.i) / (a.l + 1)) * a.e * b.e) AS w
  FROM s a JOIN s b ON a.key = b.key AND a.series = b.series AND b.i < a.i AND a.i - b.i <= a.l
  GROUP BY 1, 2),
t AS (SELECT s.key, s.series, max(n) AS n,
    sum(s * s) / (max(n) * (sum(e * e) + 2 * max(g.w))) AS stat
  FROM s JOIN g ON g.key = s.key AND g.series = s.series GROUP BY 1, 2)
SELECT key, series, n, {R('stat')} AS kpss_stat, {R(_P_VALUE)} AS kpss_p FROM t""",
    name="kpss",
)
def level_stationarity(spark, folder):
    long = melt(supply_growth(spark, folder), ["key", "period"], ["revenue", "quantity"])
    return rounded(kpss(long, ["key", "series"]), ["kpss_stat", "kpss_p"])


@query(
    f"""WITH {SUPPLY_GROWTH},
e AS (SELECT key, revenue - avg(revenue) OVER (PARTITION BY key) AS e,
    row_number() OVER (PARTITION BY key ORDER BY period) AS i FROM growth),
v AS (SELECT key, sum(e * e) AS v, count(*) AS n FROM e GROUP BY 1)
SELECT a.key, k::INTEGER AS lag, max(v.n) AS n, {R('sum(a.e * b.e) / max(v.v)')} AS acf
FROM e a JOIN generate_series(1, 12) AS g(k) ON true
JOIN e b ON b.key = a.key AND b.i = a.i - k JOIN v ON v.key = a.key
GROUP BY 1, 2"""
)
def acf(spark, folder):
    out = autocorrelation(supply_growth(spark, folder), ["key"], "revenue", 12)
    return rounded(out, ["acf"])


_CCF = """
pairs AS (
  SELECT key, 'quantity' AS predictor, period, revenue AS y, quantity AS x FROM growth
  UNION ALL SELECT key, 'lines', period, revenue, lines FROM growth),
e AS (SELECT key, predictor, y - avg(y) OVER k AS y, x - avg(x) OVER k AS x,
    row_number() OVER (PARTITION BY key, predictor ORDER BY period) AS i
  FROM pairs WINDOW k AS (PARTITION BY key, predictor)),
v AS (SELECT key, predictor, sqrt(sum(y * y) * sum(x * x)) AS v, count(*) AS n
  FROM e GROUP BY 1, 2),
ccf AS (SELECT a.key, a.predictor, (b.i - a.i)::INTEGER AS lag, max(v.n) AS n,
    sum(a.y * b.x) / max(v.v) AS ccf
  FROM e a JOIN e b ON b.key = a.key AND b.predictor = a.predictor AND abs(b.i - a.i) <= 12
  JOIN v ON v.key = a.key AND v.predictor = a.predictor GROUP BY 1, 2, 3)"""

LINES_GROWTH = """
lines_m AS (SELECT l_suppkey AS key, date_trunc('month', l_shipdate)::DATE AS period,
    sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity) AS quantity,
    count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1, 2),
growth AS (SELECT * FROM (
    SELECT key, period, (revenue / lag(revenue) OVER w - 1) * 100 AS revenue,
      (quantity / lag(quantity) OVER w - 1) * 100 AS quantity,
      (lines / lag(lines) OVER w - 1) * 100 AS lines
    FROM lines_m WINDOW w AS (PARTITION BY key ORDER BY period)) WHERE revenue IS NOT NULL)"""


def lines_growth(spark, folder):
    from tspanel.operators.panel import resample
    from tspanel.operators.transform import pct_change

    from .registry import table

    monthly = resample(
        table(spark, folder, "lineitem").withColumnRenamed("l_suppkey", "key"),
        ["key"],
        "l_shipdate",
        "month",
        {
            "revenue": F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))),
            "quantity": F.sum("l_quantity"),
            "lines": F.count(F.lit(1)).cast("double"),
        },
    )
    return pct_change(monthly, ["key"], ["revenue", "quantity", "lines"], "revenue")


@query(
    f"WITH {LINES_GROWTH}, {_CCF} SELECT key, predictor, lag, n, {R('ccf')} AS ccf FROM ccf"
)
def ccf(spark, folder):
    growth = lines_growth(spark, folder)
    out = cross_correlation(growth, ["key"], "revenue", ["quantity", "lines"], 12)
    return rounded(out, ["ccf"])


@query(
    f"""WITH {LINES_GROWTH}, {_CCF}
SELECT key, lag, {R("max(CASE WHEN predictor = 'quantity' THEN ccf END)")} AS quantity,
  {R("max(CASE WHEN predictor = 'lines' THEN ccf END)")} AS lines
FROM ccf WHERE lag <= 0 GROUP BY 1, 2"""
)
def ccf_table(spark, folder):
    growth = lines_growth(spark, folder)
    names = ["quantity", "lines"]
    long = cross_correlation(growth, ["key"], "revenue", names, 12, both_sides=False)
    table = rounded(correlation_table(long, ["key"], names, 12), names)
    return table.orderBy("key", F.desc("lag"))


@query(
    f"""WITH {SUPPLY_MONTHLY},
o AS (SELECT key, period, discount, datediff('month', DATE '1970-01-01', period) AS t FROM supply),
b AS (SELECT *, CASE WHEN t - lag(t) OVER w > 1 THEN 1 ELSE 0 END AS gap FROM o
  WINDOW w AS (PARTITION BY key ORDER BY period)),
runs AS (SELECT *, sum(gap) OVER (PARTITION BY key ORDER BY period) AS run FROM b),
len AS (SELECT key, run, count(*) AS n,
    row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, run) AS place
  FROM runs GROUP BY 1, 2),
kept AS (SELECT r.key, r.period, r.discount, l.n FROM runs r JOIN len l
  ON l.key = r.key AND l.run = r.run AND l.place = 1),
e AS (SELECT key, n, discount - avg(discount) OVER (PARTITION BY key) AS e,
    row_number() OVER (PARTITION BY key ORDER BY period) AS i FROM kept),
v AS (SELECT key, sum(e * e) AS v FROM e GROUP BY 1)
SELECT a.key, k::INTEGER AS lag, max(a.n) AS n, {R('sum(a.e * b.e) / max(v.v)')} AS acf
FROM e a JOIN generate_series(1, 3) AS g(k) ON true
JOIN e b ON b.key = a.key AND b.i = a.i - k JOIN v ON v.key = a.key GROUP BY 1, 2"""
)
def acf_longest_run(spark, folder):
    """With missing periods: only the longest stretch without a gap counts."""
    levels = supply_monthly(spark, folder).select("key", "period", "discount")
    return rounded(autocorrelation(levels, ["key"], "discount", 3, "month"), ["acf"])


@query(
    f"""WITH {ORDERS_GROWTH}, long AS (
  SELECT key, 'price' AS series, period, price AS value FROM growth
  UNION ALL SELECT key, 'orders', period, orders FROM growth)
SELECT key, series, period, quarter(period)::INTEGER AS season, {R('value')} AS value,
  {R('avg(value) OVER (PARTITION BY key, series, quarter(period))')} AS season_mean FROM long""",
    name="seasonal_subseries",
)
def subseries(spark, folder):
    long = melt(orders_growth(spark, folder), ["key", "period"], ["price", "orders"])
    out = seasonal_subseries(long, ["key", "series"], "quarter")
    return rounded(out, ["value", "season_mean"])


# -- the decomposition in SQL: local fits as weighted sums, written out for two passes --


def loess_sql(name: str, points: str, at: str, group: str, window: int, degree: int) -> str:
    """CTE ``<name>``: the local fit of ``points`` (group, x from 0, y, weight k) at ``at`` (group, x)."""
    by = ", ".join(f"a.{g}" for g in group.split(", "))
    slope = (
        "+ CASE WHEN sqrt(greatest(sxx, 0)) > 0.001 * greatest(n - 1, 1) THEN (x - c) * sxy / sxx ELSE 0 END"
        if degree
        else ""
    )
    return f"""
{name}_n AS (SELECT {group}, count(*) AS n FROM {points} GROUP BY ALL),
{name}_a AS (SELECT {by}, a.x, n, least({window}, n) AS q,
    greatest(0, least(ceil(a.x - least({window}, n) / 2.0), n - least({window}, n))) AS l
  FROM {at} a JOIN {name}_n USING ({group})),
{name}_d AS (SELECT {by}, a.x, n, p.x - a.x AS off, y, k, abs(p.x - a.x) / greatest(
    greatest(a.x - l, l + q - 1 - a.x) + greatest(0, floor(({window} - n) / 2.0)), 1e-12) AS r
  FROM {name}_a a JOIN {points} p USING ({group}) WHERE p.x BETWEEN l AND l + q - 1),
{name}_w AS (SELECT *, k * CASE WHEN r <= 0.001 THEN 1.0 WHEN r < 0.999 THEN pow(1 - pow(r, 3), 3)
    ELSE 0.0 END AS w FROM {name}_d),
{name}_m AS (SELECT {group}, x, max(n) AS n, x + sum(w * off) / sum(w) AS c, sum(w * y) / sum(w) AS mean,
    sum(w * off * off) / sum(w) - pow(sum(w * off) / sum(w), 2) AS sxx,
    sum(w * off * y) / sum(w) - sum(w * off) * sum(w * y) / pow(sum(w), 2) AS sxy
  FROM {name}_w GROUP BY {group}, x),
{name} AS (SELECT {group}, x, mean {slope} AS y FROM {name}_m)"""


def pass_sql(k: int, m: int, trend_window: int) -> str:
    """CTEs ``season<k>`` and ``trend<k>`` from ``trend<k - 1>`` and ``base`` (key, x, y, k)."""
    low_window = m + 1 - m % 2
    mean = "avg({}) OVER (PARTITION BY key ORDER BY x ROWS BETWEEN CURRENT ROW AND {} FOLLOWING)"
    return f"""
part{k} AS (SELECT key, b.x % {m} AS phase, b.x // {m} AS x, b.y - t.y AS y, b.k
  FROM base b JOIN trend{k - 1} t USING (key, x)),
ends{k} AS (SELECT key, phase, unnest(range(-1, max(x) + 2)) AS x FROM part{k} GROUP BY 1, 2),
{loess_sql(f"cycle{k}", f"part{k}", f"ends{k}", "key, phase", 11, 0)},
line{k} AS (SELECT key, (x + 1) * {m} + phase AS x, y FROM cycle{k}),
once{k} AS (SELECT key, x, {mean.format("y", m - 1)} AS y FROM line{k}),
twice{k} AS (SELECT key, x, {mean.format("y", m - 1)} AS y FROM once{k}),
thrice{k} AS (SELECT key, x, {mean.format("y", 2)} AS y FROM twice{k}),
low{k} AS (SELECT t.key, t.x, t.y, 1 AS k FROM thrice{k} t JOIN base b ON b.key = t.key AND b.x = t.x),
{loess_sql(f"pass{k}", f"low{k}", "base", "key", low_window, 1)},
season{k} AS (SELECT p.key, p.x, l.y - p.y AS y FROM pass{k} p JOIN line{k} l ON l.key = p.key AND l.x = p.x + {m}),
rest{k} AS (SELECT b.key, b.x, b.y - s.y AS y, b.k FROM base b JOIN season{k} s ON s.key = b.key AND s.x = b.x),
{loess_sql(f"trend{k}", f"rest{k}", "base", "key", trend_window, 1)}"""


def stl_sql(m: int, trend_window: int) -> str:
    """CTE ``parts`` from ``base`` (key, period, x, y, k): k is 1 for known values, 0 for others, whose y is 0."""
    return f"""
trend0 AS (SELECT key, x, 0.0::DOUBLE AS y FROM base),
{pass_sql(1, m, trend_window)},
{pass_sql(2, m, trend_window)},
parts AS (SELECT b.key, period, b.y AS value, t.y AS trend, s.y AS season, b.y - t.y - s.y AS remainder
  FROM base b JOIN trend2 t ON t.key = b.key AND t.x = b.x JOIN season2 s ON s.key = b.key AND s.x = b.x)"""


QUARTERLY_PARTS = f"""WITH {ORDERS_GROWTH},
base AS (SELECT key, period, row_number() OVER (PARTITION BY key ORDER BY period) - 1 AS x, price AS y, 1 AS k
  FROM growth), {stl_sql(4, 7)}"""

MONTHLY_PARTS = f"""WITH {SUPPLY_GROWTH},
months AS (SELECT key, unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH))::DATE AS period
  FROM growth GROUP BY key HAVING count(*) >= 24),
base AS (SELECT m.key, m.period, coalesce(revenue, 0) AS y, (revenue IS NOT NULL)::INT AS k,
    row_number() OVER (PARTITION BY m.key ORDER BY m.period) - 1 AS x
  FROM months m LEFT JOIN growth g ON g.key = m.key AND g.period = m.period),
{stl_sql(12, 21)}"""


@query(
    QUARTERLY_PARTS
    + f"""
SELECT key, period, {R('value')} AS value, {R('trend')} AS trend, {R('season')} AS season,
  {R('remainder')} AS remainder FROM parts""",
    name="stl",
)
def decomposition(spark, folder):
    """Trend, season and remainder of quarterly growth."""
    parts = stl(orders_growth(spark, folder), ["key"], "quarter", "price").drop("season_adjust", "status")
    return rounded(parts, ["value", "trend", "season", "remainder"])


@query(
    MONTHLY_PARTS
    + f"""
SELECT g.key, g.period, {R('g.revenue')} AS value, {R('trend')} AS trend, {R('season')} AS season,
  {R('remainder')} AS remainder, {R('value - season')} AS season_adjust, CASE WHEN p.key IS NULL THEN 'short' ELSE 'ok' END AS status
FROM growth g LEFT JOIN parts p ON p.key = g.key AND p.period = g.period"""
)
def stl_components(spark, folder):
    """A row for every month of growth; months without one have no weight."""
    parts = stl(supply_growth(spark, folder), ["key"], "month", "revenue")
    return rounded(parts, ["value", "trend", "season", "remainder", "season_adjust"])


def sometimes_missing(df):
    """About every eleventh value is taken out: some as rows, some as values only."""
    turn = (F.col("key") * 7 + F.year("period") * 12 + F.month("period")) % 23
    return df.withColumn("revenue", F.when(turn != 4, F.col("revenue"))).filter(turn != 15)


@query(
    f"""WITH {SUPPLY_GROWTH},
holes AS (SELECT key, period, CASE WHEN (key * 7 + year(period) * 12 + month(period)) % 23 <> 4 THEN revenue END AS revenue
  FROM growth WHERE (key * 7 + year(period) * 12 + month(period)) % 23 <> 15),
months AS (SELECT key, unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH))::DATE AS period
  FROM holes GROUP BY key HAVING count(revenue) >= 24),
base AS (SELECT m.key, m.period, coalesce(revenue, 0) AS y, (revenue IS NOT NULL)::INT AS k,
    row_number() OVER (PARTITION BY m.key ORDER BY m.period) - 1 AS x
  FROM months m LEFT JOIN holes g ON g.key = m.key AND g.period = m.period),
{stl_sql(12, 21)}
SELECT g.key, g.period, {R('g.revenue')} AS value, {R('trend')} AS trend, {R('season')} AS season,
  CASE WHEN g.revenue IS NOT NULL THEN {R('remainder')} END AS remainder,
  CASE WHEN p.key IS NULL THEN 'short' WHEN g.revenue IS NULL THEN 'missing' ELSE 'ok' END AS status
FROM holes g LEFT JOIN parts p ON p.key = g.key AND p.period = g.period"""
)
def stl_missing(spark, folder):
    """Trend and season of series with missing months and missing values."""
    holes = sometimes_missing(supply_growth(spark, folder).select("key", "period", "revenue"))
    parts = stl(holes, ["key"], "month", "revenue").drop("season_adjust")
    return rounded(parts, ["value", "trend", "season", "remainder"])


@query(
    MONTHLY_PARTS
    + f"""
SELECT g.key, {R('greatest(0.0, 1 - coalesce(var_pop(remainder) / var_pop(season + remainder), 1))')}
  AS strength FROM growth g LEFT JOIN parts p ON p.key = g.key AND p.period = g.period GROUP BY g.key"""
)
def stl_strength(spark, folder):
    parts = stl(supply_growth(spark, folder), ["key"], "month", "revenue")
    return rounded(seasonal_strength(parts, ["key"]), ["strength"])
