"""SQL for least sums of squared one-step errors, found by zooming into a grid of coefficients.

The mean is eliminated in closed form for every point of the grid, as the errors are linear in it. Missing
months are passed over: their error is 0 and their one-step forecast stands in for them.
"""

from __future__ import annotations

LEVELS_1, POINTS_1 = 8, 41
LEVELS_2, POINTS_2 = 9, 15


def _zoom(out: str, names: list[str], start: list[tuple[float, float]], score) -> tuple[str, str]:
    """CTEs that narrow the ranges of the coefficients level by level.

    ``score(grid, steps)`` selects key, coefficients, steps and sse of the points of a grid.
    """
    levels, points = (LEVELS_1, POINTS_1) if len(names) == 1 else (LEVELS_2, POINTS_2)
    # the first ranges bound all others
    best = ", ".join(
        f"greatest(arg_min({n}, sse) - any_value({n}_step), {lo}) AS {n}_lo, least(arg_min({n}, sse) + any_value({n}_step), {hi}) AS {n}_hi"
        for n, (lo, hi) in zip(names, start)
    )
    ranges = ", ".join(f"{lo}::DOUBLE AS {n}_lo, {hi}::DOUBLE AS {n}_hi" for n, (lo, hi) in zip(names, start))
    sql = f"{out}_z0 AS (SELECT DISTINCT key, {ranges} FROM {out}_r)"
    for level in range(levels):
        cells = ", ".join(f"{n}_lo + ({n}_hi - {n}_lo) * {n}_i / {points - 1} AS {n}, ({n}_hi - {n}_lo) / {points - 1} AS {n}_step" for n in names)
        series = ", ".join(f"generate_series(0, {points - 1}) AS {n}_s({n}_i)" for n in names)
        grid = f"(SELECT key, {cells} FROM {out}_z{level}, {series})"
        sql += f""",
{out}_z{level + 1} AS (SELECT key, {best} FROM ({score(grid, ", ".join(f"{n}_step" for n in names))}) GROUP BY key)"""
    final = ", ".join(f"({n}_lo + {n}_hi) / 2 AS {n}" for n in names)
    return sql, f"(SELECT key, {final} FROM {out}_z{levels})"


def ar1_sql(out: str, rows: str, constant: bool = True) -> str:
    """CTE ``out`` (key, phi, mu, n, sse, u_last): a first-order autoregression of ``rows`` (key, period, y).

    After g - 1 missing months the forecast is phi to the power g times the last deviation from the mean.
    """
    level = "avg(y) OVER (PARTITION BY key)" if constant else "0.0"
    a, b = "y - coalesce(pow(phi, g) * y1, 0)", "1 - coalesce(pow(phi, g), 0)"
    sse = "sum(a * a) - pow(sum(a * b), 2) / sum(b * b)" if constant else "sum(a * a)"

    def score(grid: str, steps: str) -> str:
        errors = f"SELECT r.key, phi, {steps}, {a} AS a, {b} AS b FROM {out}_r r JOIN {grid} c ON c.key = r.key"
        return f"SELECT key, phi, {steps}, {sse} AS sse FROM ({errors}) GROUP BY ALL"

    zoom, best = _zoom(out, ["phi"], [(-0.999, 0.999)], score)
    mu = "sum(a * b) / sum(b * b)" if constant else "0.0"
    # Gauss-Newton steps from the grid's best point, as sums of squares alone fix it to half the digits
    polish, last = "", best
    for step in range(4):
        table = f"(SELECT r.key, phi, y1, g, {a} AS a, {b} AS b FROM {out}_r r JOIN {last} z ON z.key = r.key)"
        part = "d - b * sum(d * b) OVER k / sum(b * b) OVER k" if constant else "d"
        polish += f""",
{out}_n{step} AS (SELECT key, phi + sum(e * part) / sum(part * part) AS phi FROM (
  SELECT key, phi, e, {part} AS part FROM (
    SELECT key, phi, b, a - m * b AS e, coalesce(g * pow(phi, g - 1) * (y1 - m), 0) AS d FROM (
      SELECT *, {"sum(a * b) OVER k / sum(b * b) OVER k" if constant else "0.0"} AS m FROM {table} WINDOW k AS (PARTITION BY key)))
  WINDOW k AS (PARTITION BY key)) GROUP BY key, phi)"""
        last = f"{out}_n{step}"
    best = last
    return f"""
{out}_c AS (SELECT key, period, y - {level} AS y, {level} AS mid FROM ({rows}) WHERE y IS NOT NULL),
{out}_r AS (SELECT key, period, y, mid, lag(y) OVER w AS y1, datediff('month', lag(period) OVER w, period) AS g
  FROM {out}_c WINDOW w AS (PARTITION BY key ORDER BY period)),
{zoom}{polish},
{out} AS (SELECT key, phi, mid + m AS mu, n, sse, y_last - m AS u_last FROM (
  SELECT key, phi, any_value(mid) AS mid, {mu} AS m, count(*) AS n, {sse} AS sse, arg_max(y, period) AS y_last
  FROM (SELECT r.key, r.period, r.y, r.mid, phi, {a} AS a, {b} AS b FROM {out}_r r JOIN {best} z ON z.key = r.key) GROUP BY key, phi))"""


def arma_sql(out: str, rows: str, p: int, q: int) -> str:
    """CTE ``out`` (key, phi, phi2, theta, mu, n, sse) with a mean; p + q is 1 or 2, q at most 1."""
    names = [*(["phi"] if p else []), *(["phi2"] if p == 2 else []), *(["theta"] if q else [])]
    start = {"phi": (-1.98, 1.98) if p == 2 else (-0.99, 0.99), "phi2": (-0.99, 0.99), "theta": (-0.99, 0.99)}
    phi, phi2, theta = ("phi" if p else "0.0"), ("phi2" if p == 2 else "0.0"), ("theta" if q else "0.0")
    ly = f"({phi} * s.u1 + {phi2} * s.u2 + {theta} * s.e)"
    lo = f"({phi} * s.v1 + {phi2} * s.v2 + {theta} * s.f)"
    e, f = f"(x.k * (x.y - {ly}))", f"(x.k * (1 - {lo}))"
    # state: the last two values and errors of the series, and of a series of ones
    state = f"""{{'y': x.y, 'k': x.k, 'u1': x.k * x.y + (1 - x.k) * {ly}, 'u2': s.u1, 'e': {e},
      'v1': x.k + (1 - x.k) * {lo}, 'v2': s.v1, 'f': {f}, 'aa': s.aa + pow({e}, 2), 'ab': s.ab + {e} * {f}, 'bb': s.bb + pow({f}, 2)}}"""
    run = f"list_reduce(list_prepend({_zero('0.0', '0.0')}, items), lambda s, x: {state})"
    listed = ", ".join(names)

    def score(grid: str, steps: str) -> str:
        return f"""SELECT key, {listed}, {steps}, t.aa - t.ab * t.ab / t.bb AS sse FROM (
      SELECT r.key, {listed}, {steps}, {run} AS t FROM {out}_r r JOIN {grid} c ON c.key = r.key)"""

    zoom, best = _zoom(out, names, [start[n] for n in names], score)
    values = ", ".join(f"{n if n in names else '0.0'} AS {n}" for n in ("phi", "phi2", "theta"))
    return f"""
{out}_c AS (SELECT key, period, y - avg(y) OVER (PARTITION BY key) AS y, avg(y) OVER (PARTITION BY key) AS mid
  FROM ({rows}) WHERE y IS NOT NULL),
{out}_m AS (SELECT key, unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH))::DATE AS period FROM {out}_c GROUP BY key),
{out}_r AS (SELECT m.key, any_value(mid) AS mid, count(y) AS n,
    list({_zero('coalesce(y, 0)', '(y IS NOT NULL)::INT::DOUBLE')} ORDER BY m.period) AS items
  FROM {out}_m m LEFT JOIN {out}_c c ON c.key = m.key AND c.period = m.period GROUP BY m.key),
{zoom},
{out} AS (SELECT key, {values}, n, mid + t.ab / t.bb AS mu, t.aa - t.ab * t.ab / t.bb AS sse FROM (
  SELECT r.key, n, mid, {', '.join(names)}, {run} AS t FROM {out}_r r JOIN {best} z ON z.key = r.key))"""


def _zero(y: str, k: str) -> str:
    rest = ", ".join(f"'{c}': 0.0::DOUBLE" for c in ("u1", "u2", "e", "v1", "v2", "f", "aa", "ab", "bb"))
    return f"{{'y': ({y})::DOUBLE, 'k': ({k})::DOUBLE, {rest}}}"


def seasonal_ar_sql(out: str, rows: str) -> str:
    """CTE ``out`` (key, phi, sphi, mu, n, sse): (1 - phi B)(1 - sphi B^12) on gapless months, with a mean.

    The error is y - phi y1 - sphi y12 + phi sphi y13, the same for the ones that the mean multiplies;
    lags before the first month are 0. Sums of products of these columns serve every point of the grid.
    """
    lags = [(0, "1"), (1, "phi"), (12, "sphi"), (13, "phi * sphi")]
    sign = ["", "-", "-", ""]
    columns = [(f"{kind}{lag}") for kind in ("y", "i") for lag, _ in lags]
    sums = ", ".join(f"sum({a} * {b}) AS {a}_{b}" for i, a in enumerate(columns) for b in columns[i:])

    def product(one: str, two: str) -> str:
        terms = []
        for i, (l1, c1) in enumerate(lags):
            for j, (l2, c2) in enumerate(lags):
                a, b = sorted((f"{one}{l1}", f"{two}{l2}"), key=columns.index)
                minus = "-" if (sign[i] == "-") != (sign[j] == "-") else "+"
                terms.append(f"{minus} {c1} * {c2} * {a}_{b}")
        return "(" + " ".join(terms) + ")"

    sse = f"{product('y', 'y')} - pow({product('y', 'i')}, 2) / {product('i', 'i')}"

    def score(grid: str, steps: str) -> str:
        return f"SELECT r.key, phi, sphi, {steps}, {sse} AS sse FROM {out}_r r JOIN {grid} c ON c.key = r.key"

    zoom, best = _zoom(out, ["phi", "sphi"], [(-0.99, 0.99), (-0.99, 0.99)], score)
    lagged = ", ".join(f"coalesce(lag(y, {lag}) OVER w, 0) AS y{lag}, (i > {lag})::INT::DOUBLE AS i{lag}" for lag, _ in lags)
    return f"""
{out}_c AS (SELECT key, period, y - avg(y) OVER (PARTITION BY key) AS y, avg(y) OVER (PARTITION BY key) AS mid,
    row_number() OVER (PARTITION BY key ORDER BY period) AS i FROM ({rows}) WHERE y IS NOT NULL),
{out}_r AS (SELECT key, any_value(mid) AS mid, count(*) AS n, {sums} FROM (
  SELECT key, mid, {lagged} FROM {out}_c WINDOW w AS (PARTITION BY key ORDER BY period)) GROUP BY key),
{zoom},
{out} AS (SELECT r.key, phi, sphi, n, mid + {product('y', 'i')} / {product('i', 'i')} AS mu, {sse} AS sse
  FROM {out}_r r JOIN {best} z ON z.key = r.key)"""
