"""Regressions with ARIMA errors for many keys and specifications in one job.

Estimation starts from the regression method of Hannan and Rissanen (1982) and takes Gauss-Newton steps
on the conditional sum of squares: not exact maximum likelihood.

1. Gaps of the calendar become rows without values, so that every offset is a calendar offset.
2. Regress on seasons, lagged columns and pulses (differenced if asked).
3. Each series travels once, as one row, to a solver that works on slices of a batch. It compares the orders of
   a specification, keeping only the best one so far, and estimates the winner jointly with its
   regression. Unknown values are passed over by their one-step forecasts.

All steps are clustered by key, and per-key results are joined back on the key. Each set of fits
is stored once (``stage``), so no step recomputes the ones before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tspanel.functions import FREQUENCIES, period_index
from tspanel.functions.criteria import likelihood_criteria
from tspanel.operators import arma
from tspanel.operators.algebra import pieces, slices
from tspanel.operators.design import Design, check_names
from tspanel.operators.describe import as_series, kpss, seasonal_strength, stl
from tspanel.operators.forecast import extended, with_intervals
from tspanel.operators.panel import fill_gaps, melt
from tspanel.operators.regression import fit_regressions, nest_fits, predict, residuals
from tspanel.operators.spec import Arima, Regression
from tspanel.operators.transform import differenced
from tspanel.session import stage

# The seasonal strength above which a series is differenced by season,
# and the test level for ordinary differences.
STRENGTH_LIMIT = 0.64
KPSS_LEVEL = 0.05
# Column names are not case-sensitive: seasonal orders are called sp, sd, sq.
ORDER_COLUMNS = ("p", "q", "sp", "sq")

# The pairs of ordinary and seasonal differences that the tests can choose.
AUTO_DIFFERENCES = ((0, 0), (1, 0), (2, 0), (0, 1), (1, 1))


def _structure(spec: Arima, d: int, D: int, constant: bool | None = None) -> Regression:
    return replace(spec.mean_model(d, D, constant), name="", family="")


def _differences(spec: Arima) -> list[tuple[int, int]]:
    """The (d, D) pairs a specification can end up with."""
    if spec.d is not None and spec.D is not None:
        return [(spec.d, spec.D)]
    return sorted(
        {
            (d if spec.d is None else spec.d, D if spec.D is None else spec.D)
            for d, D in AUTO_DIFFERENCES
        }
    )


class _Means:
    """The distinct mean structures of a list of specifications, by a short name."""

    def __init__(self, specs: Sequence[Arima]):
        self.models: dict[Regression, Regression] = {}
        self.names: dict[tuple[str, int, int], list[tuple[bool, str]]] = {}
        for spec in specs:
            for d, D in _differences(spec):
                for constant in spec.constants():
                    shape = _structure(spec, d, D, constant)
                    if shape not in self.models:
                        self.models[shape] = replace(shape, name=f"mean{len(self.models)}")
                    self.names.setdefault((spec.name, d, D), []).append((constant, self.models[shape].name))


def choose_differences(
    frame: DataFrame, keys: Sequence[str], bases: Sequence[Regression], freq: str
) -> DataFrame:
    """``(keys, model, sd, d0, d1)`` for level regressions without orders.

    ``sd`` is 1 where the season explains most of the detrended residual. ``d0`` and
    ``d1`` count the ordinary differences until the level-stationarity test passes,
    without and with a seasonal difference.
    """
    by = [*keys, "model"]
    m = FREQUENCIES[freq].seasons
    fits = fit_regressions(frame, keys, bases, freq)
    left = stage(residuals(frame, fits, keys, bases, freq).select(*by, "period", "residual"), keys)
    strength = seasonal_strength(stl(left, by, freq, "residual"), by)
    steps = [(0, 0), (1, 0), (0, 1), (1, 1)]
    tested = left.withColumns(
        {f"w{d}{D}": differenced("residual", 0, d, D, m, by) for d, D in steps}
    ).select(*by, "period", *[f"w{d}{D}" for d, D in steps])
    long = melt(tested, [*by, "period"], [f"w{d}{D}" for d, D in steps], "variant", "value")
    p = kpss(long, [*by, "variant"]).groupBy(*by).agg(
        *[F.max(F.when(F.col("variant") == f"w{d}{D}", F.col("kpss_p"))).alias(f"p{d}{D}") for d, D in steps]
    )

    def rejected(name: str) -> Column:
        return F.coalesce(F.col(name) < KPSS_LEVEL, F.lit(False))

    return p.join(strength, by, "left").select(
        *by,
        F.when(F.col("strength") > STRENGTH_LIMIT, 1).otherwise(0).alias("sd"),
        F.when(~rejected("p00"), 0).when(~rejected("p10"), 1).otherwise(2).alias("d0"),
        F.when(~rejected("p01"), 0).otherwise(1).alias("d1"),
    )


def _chosen_means(
    frame: DataFrame, keys: Sequence[str], specs: Sequence[Arima], means: _Means, freq: str
) -> DataFrame:
    """``(keys, spec, constant, mean, d, sd)``: the mean structures of every specification and key."""
    bases = {}
    for s in specs:
        if s.d is None or s.D is None:
            bases.setdefault(_structure(s, 0, 0), f"base{len(bases)}")
    tests = choose_differences(
        frame, keys, [replace(b, name=n) for b, n in bases.items()], freq
    )
    nested = nest_fits(tests, keys, ["sd", "d0", "d1"])
    entries = []
    for s in specs:
        if s.d is None or s.D is None:
            test = F.col("_fits")[bases[_structure(s, 0, 0)]]
            D = F.lit(s.D) if s.D is not None else F.coalesce(test["sd"], F.lit(0))
            found = F.when(D > 0, test["d1"]).otherwise(test["d0"])
            d = F.lit(s.d) if s.d is not None else F.coalesce(found, F.lit(0))
        else:
            D, d = F.lit(s.D), F.lit(s.d)
        for constant in s.constants():
            mean = F.lit(None).cast("string")
            for (name, d_, D_), choices in means.names.items():
                if name == s.name:
                    mean = F.when((d == d_) & (D == D_), dict(choices)[constant]).otherwise(mean)
            entries.append(
                F.struct(
                    F.lit(s.name).alias("spec"), F.lit(constant).alias("constant"), mean.alias("mean"),
                    d.alias("d"), D.alias("sd"),
                )
            )
    return stage(nested.select(*keys, F.inline(F.array(*entries))).filter("mean is not null"), keys)


def _grids(users: dict[str, Sequence[Arima]]) -> dict[str, list[tuple[int, int, int, int]]]:
    return {mean: sorted({o for s in specs for o in s.orders()}) for mean, specs in users.items()}


def _listed(grid: list[tuple[int, int, int, int]]) -> Column:
    """The orders as one constant array of structs."""
    items = (
        "named_struct(" + ", ".join(f"'{c}', {v}" for c, v in zip(ORDER_COLUMNS, o)) + ")"
        for o in grid
    )
    return F.expr(f"array({', '.join(items)})")


def candidates(
    u: DataFrame,
    keys: Sequence[str],
    users: dict[str, Sequence[Arima]],
    freq: str,
    long_ar: int | None = None,
) -> DataFrame:
    """Every order of every mean structure by two-step estimates, in the additive form.

    ``u`` is ``(keys, model, period, residual)`` with the mean structure in ``model``;
    ``users`` lists the specifications per structure. Returns one row per (key,
    structure): ``n`` and the array ``found`` of ``(p, q, sp, sq, sse, stable)``. All orders of a
    structure use all rows, so their criteria compare. ``seasons`` is the number of periods in a year.
    """
    m = FREQUENCIES[freq].seasons
    by = [*keys, "model"]
    grids = _grids(users)

    @F.pandas_udf("struct<sse: array<double>, stable: array<boolean>>")
    def solve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for model, series in pieces(batches):
            sse, stable = ([None] * len(model) for _ in range(2))
            for name, members in model.groupby(model).indices.items():
                longest = int(series.iloc[members].str.len().max())
                for where in slices(members, 16 * longest):
                    values, live = _padded(series.iloc[where].to_numpy())
                    found = list(arma.two_step(values, live, grids[name], m, long_ar))
                    sums = np.stack([f[0] for f in found], 1)
                    oks = np.stack([arma.is_stable(ar) & arma.is_stable(-ma) for _, ar, ma in found], 1)
                    for i, w in enumerate(where):
                        sse[w], stable[w] = sums[i], oks[i]
            yield pd.DataFrame({"sse": sse, "stable": stable})

    orders = _listed(next(iter(grids.values())))
    for name, grid in list(grids.items())[1:]:
        if grid != grids[next(iter(grids))]:
            orders = F.when(F.col("model") == name, _listed(grid)).otherwise(orders)
    found = F.transform(
        F.arrays_zip(orders.alias("o"), F.col("s.sse").alias("sse"), F.col("s.stable").alias("ok")),
        lambda x: F.struct(
            *[x["o"][c].alias(c) for c in ORDER_COLUMNS],
            x["sse"].alias("sse"),
            x["ok"].alias("stable"),
        ),
    )
    series = as_series(u.select(*by, "period", "residual"), by, ["residual"])
    return series.withColumn("s", solve("model", "residual")).select(
        *by, F.size("residual").cast("long").alias("n"), found.alias("found"), F.lit(m).alias("seasons")
    )


def _n_lags(order: Callable[[str], Column], m: Column) -> Column:
    """Number of different lags of both polynomials: one coefficient where they coincide."""
    total = F.lit(0)
    for plain, seasonal in (("p", "sp"), ("q", "sq")):
        shared = F.least(F.floor(order(plain) / m).cast("int"), order(seasonal))
        total = total + order(plain) + order(seasonal) - shared
    return total


def candidate_table(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per candidate: ``(keys, model, n, p, q, sp, sq, sse, stable, k, aicc)``.

    ``mean_rank``, the number of regression terms, has to be a column of ``found``.
    """
    rows = found.select(*keys, "model", "n", "mean_rank", "seasons", F.inline("found"))
    k = _n_lags(F.col, F.col("seasons")) + F.col("mean_rank") + 1
    criteria = likelihood_criteria(F.col("n"), k, F.col("sse"))
    aicc = F.when(F.col("stable"), criteria["aicc"])
    return rows.withColumn("k", k).withColumn("aicc", aicc).drop("mean_rank", "seasons")


FIT = (
    "struct<n: bigint, sse: double, p: int, q: int, sp: int, sq: int, beta: array<double>, params: array<double>,"
    " ar: array<double>, ma: array<double>, inverse: array<double>, stable: boolean, converged: boolean, tried: int>"
)


def fit_arima(
    train: DataFrame,
    keys: Sequence[str],
    specs: Sequence[Arima],
    freq: str,
    long_ar: int | None = None,
    refine: int = 50,
    only: DataFrame | None = None,
    approximation: bool = True,
) -> DataFrame:
    """Fit every specification for every key; one row per (key, model).

    Columns: ``family, mean, constant, d, sd, p, q, sp, sq, orders, stable, converged, tried, n, rank, sse, sigma2,
    loglik, aic, aicc, bic, terms, beta, params, ar, ma``, and the coefficients with their normal
    matrix in ``coef_terms, coef_values, inverse, coef``; ``ar`` and ``ma`` are whole polynomials by
    lag, ``params`` the coefficients of their factors.

    Orders given as ranges are compared by AICc on a common sample: by two-step estimates, or, with
    ``approximation`` False, by joint estimates of all orders that could still win (``tried`` of them). The
    winner is estimated by joint Gauss-Newton steps until they gain nothing, ``refine`` at most;
    ``converged`` says whether that was reached. With 0 the two-step estimates stay.

    Periods without a row, and rows with a missing value, are passed over: ``n`` counts the others. A
    key without a complete row has no fit. ``only`` holds ``(keys, models)``: per key, the
    specifications to fit.
    """
    check_names(specs)
    if any("|" in s.name for s in specs):
        raise ValueError("names of ARIMA models may not contain |")
    m = FREQUENCIES[freq].seasons
    train = fill_gaps(train, keys, freq)
    means = _Means(specs)
    shapes = list(means.models.values())
    static = all(s.d is not None and s.D is not None for s in specs)
    if static:
        entries = [
            F.struct(
                F.lit(s.name).alias("spec"), F.lit(constant).alias("constant"), F.lit(mean).alias("mean"),
                F.lit(s.d).alias("d"), F.lit(s.D).alias("sd"),
            )
            for s in specs
            for constant, mean in means.names[(s.name, s.d, s.D)]
        ]
        chosen = train.select(*keys).distinct() if only is None else only.select(*keys)
        chosen = chosen.select(*keys, F.inline(F.array(*entries)))
    else:
        chosen = _chosen_means(train, keys, specs, means, freq)
    if only is not None:
        chosen = (
            chosen.join(only, list(keys))
            .filter(F.array_contains("models", F.col("spec")))
            .drop("models")
        )
    needed = None
    if only is not None or not static:
        needed = chosen.groupBy(*keys).agg(F.collect_set("mean").alias("models"))
    mean_fits = fit_regressions(train, keys, shapes, freq, needed)
    nested = nest_fits(mean_fits, keys, ["terms", "beta", "rank"], "_means")
    pick = F.struct("spec", "constant", "mean", "d", "sd")
    picks = chosen.groupBy(*keys).agg(F.collect_list(pick).alias("_picks"))  # one per specification and constant
    design = Design(shapes, freq)
    dense = [f"v{i}" for i in range(design.width)]
    known = design.rows(train, keys, needed).withColumns({v: F.coalesce(v, F.lit(float("nan"))) for v in dense})
    series = as_series(known, [*keys, "model"], ["cell", *dense]).withColumn("dense", F.flatten(F.array(*dense)))
    series = nest_fits(series, keys, ["cell", "dense"], "_series")
    rows = series.join(nested, list(keys)).join(picks, list(keys))
    rows = rows.withColumn("_p", F.explode("_picks")).withColumns(
        {"_m": F.col("_means")[F.col("_p.mean")], "_s": F.col("_series")[F.col("_p.mean")]}
    )
    solver = _solver(design, specs, m, long_ar, refine, not approximation)
    solved = rows.filter("_m is not null AND _s is not null").withColumn(
        "s", solver("_p.spec", "_p.mean", "_m.rank", "_s.cell", "_s.dense", "_m.beta")
    )
    known_beta = F.zip_with("_m.beta", "s.beta", lambda old, new: F.when(old.isNotNull(), new))
    # ``rank`` counts the free parameters with the variance, as the criteria do
    families = F.create_map(*[F.lit(v) for s in specs for v in (s.name, s.family)])
    out = solved.select(
        *keys, F.col("_p.spec").alias("model"), families[F.col("_p.spec")].alias("family"), "_p.mean", "_p.constant",
        "_p.d", "_p.sd", *[f"s.{c}" for c in ORDER_COLUMNS], "s.stable", "s.converged", "s.tried", "s.n",
        (F.size("s.params") + F.col("_m.rank") + 1).cast("int").alias("rank"), "s.sse", "_m.terms",
        known_beta.alias("beta"), "s.params", "s.ar", "s.ma", "s.inverse",
    )
    names = F.concat("terms", _coefficient_names(specs, m))
    values = F.concat("beta", "params")
    criteria = likelihood_criteria(F.col("n"), F.col("rank"), F.col("sse"))
    out = out.withColumns(
        {
            "orders": order_label(m),
            "sigma2": F.when(
                F.col("n") > F.col("rank") - 1, F.col("sse") / (F.col("n") - F.col("rank") + 1)
            ),
            "coef_terms": names,
            "coef_values": values,
            "coef": F.map_from_arrays(names, values),
            **criteria,
        }
    )
    if any(len(s.constants()) > 1 for s in specs):
        out = stage(out, keys)
        first = Window.partitionBy(*keys, "model").orderBy(F.col("aicc").asc_nulls_last(), "rank", "constant")
        out = out.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")
    return stage(out, keys)


def _lags(order: str, seasonal: str, m: int) -> Column:
    """The lags of a part of the model, as an array; repeats are counted once."""
    plain = F.filter(F.sequence(F.lit(0), F.col(order)), lambda i: i > 0)
    by_season = F.transform(
        F.filter(F.sequence(F.lit(0), F.col(seasonal)), lambda i: i > 0), lambda i: i * m
    )
    return F.array_union(plain, by_season)


def _lag_names(part: str, order: str, seasonal: str, m: int) -> Column:
    return F.transform(
        _lags(order, seasonal, m), lambda i: F.concat(F.lit(part), i.cast("string"))
    )


def _coefficient_names(specs: Sequence[Arima], m: int) -> Column:
    """ar1, sar1, ma1, sma1 and so on for products; names by lag where the lags add up."""

    def numbered(name: str, order: str) -> Column:
        counts = F.filter(F.sequence(F.lit(0), F.col(order)), lambda i: i > 0)
        return F.transform(counts, lambda i: F.concat(F.lit(name), i.cast("string")))

    factors = F.concat(numbered("ar", "p"), numbered("sar", "sp"), numbered("ma", "q"), numbered("sma", "sq"))
    by_lag = F.concat(_lag_names("ar", "p", "sp", m), _lag_names("ma", "q", "sq", m))
    added = [s.name for s in specs if not s.multiplicative]
    return F.when(F.col("model").isin(added), by_lag).otherwise(factors) if added else factors


def order_label(m: int) -> Column:
    return F.format_string(
        f"ARIMA(%d,%d,%d)(%d,%d,%d)[{m}]", *[F.col(c) for c in ("p", "d", "q", "sp", "sd", "sq")]
    )


def _padded(arrays: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ragged series in one matrix, values at the left, and the mask of real entries."""
    sizes = np.array([len(a) for a in arrays])
    live = np.arange(sizes.max(initial=0)) < sizes[:, None]
    out = np.zeros(live.shape)
    out[live] = np.concatenate(arrays) if len(arrays) else []
    return out, live


def _solver(design: Design, specs: Sequence[Arima], m: int, long_ar: int | None, steps: int, full: bool):
    """The order and the coefficients of one specification on one series, for batches of them."""
    terms, width = design.terms, design.width
    by_name = {s.name: s for s in specs}

    @F.pandas_udf(FIT)
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for spec, mean, rank, cell, dense, beta in pieces(batches):
            size = len(spec)
            lengths = cell.str.len().to_numpy("int64")
            out = {c.split(":")[0].strip(): [None] * size for c in FIT[7:-1].split(",")}
            groups = pd.Series(list(zip(spec, mean)))
            for (name, mean_), members in groups.groupby(groups).indices.items():
                s, t = by_name[name], terms[mean_]
                orders = s.orders()
                shapes = [arma.Shape(o, m, s.multiplicative) for o in orders]
                columns = len(t.all) + max(x.size for x in shapes) + 1
                for where in slices(members, columns * lengths[members].max()):
                    live = np.arange(lengths[where].max()) < lengths[where][:, None]
                    cells = np.zeros(live.shape, dtype=int)
                    cells[live] = np.concatenate(cell.iloc[where].to_numpy())
                    values = np.full((*live.shape, width), np.nan)
                    values[live] = np.concatenate([np.reshape(v, (width, -1)).T for v in dense.iloc[where]])
                    used = values[:, :, : len(t.lags) + 1]
                    seen = ~np.isnan(used).any(axis=2)
                    start = np.stack(beta.iloc[where].to_numpy()).astype(float).reshape(len(where), len(t.all))
                    x = np.concatenate([t.matrix[cells], used[:, :, 1:]], axis=2)
                    # aliased regressors stay out
                    x = np.where(np.isnan(start)[:, None, :] | ~seen[:, :, None], 0.0, x)
                    y, start = np.where(seen, used[:, :, 0], 0.0), np.nan_to_num(start)
                    at, coef, tried = arma.search(
                        y, x, seen, start, rank.iloc[where].to_numpy(float), orders, m, s.multiplicative, long_ar, full and steps > 0, steps
                    )
                    for k in np.unique(at):
                        g, shape = np.flatnonzero(at == k), shapes[k]
                        b, c, sse, inverse, done = arma.estimate(
                            y[g], x[g], seen[g], start[g], coef[g, : shape.size], shape, steps
                        )
                        ar, ma = shape.polynomials(c)
                        found = {
                            "n": seen[g].sum(axis=1), "sse": sse, "beta": b, "params": c, "ar": ar, "ma": ma,
                            "inverse": inverse.reshape(len(g), -1), "stable": shape.stable(c), "converged": done, "tried": tried[g],
                            **{o: np.full(len(g), v) for o, v in zip(("p", "q", "sp", "sq"), orders[k])},
                        }
                        for column, rows in found.items():
                            for row, w in zip(rows, where[g]):
                                out[column][w] = row
            yield pd.DataFrame(out)

    return solve


def _variants(specs: Sequence[Arima]) -> list[Regression]:
    """One regression per specification, possible differences and constant, ``<name>|<d>,<D>,<constant>``."""
    return [
        replace(s.mean_model(d, D, constant), name=f"{s.name}|{d},{D},{str(constant).lower()}")
        for s in specs
        for d, D in _differences(s)
        for constant in s.constants()
    ]


def _variant_fits(fits: DataFrame) -> DataFrame:
    label = F.concat_ws("|", F.col("model"), F.concat_ws(",", "d", "sd", F.col("constant").cast("string")))
    return fits.withColumn("model", label)


def forecast_arima(
    history: DataFrame,
    future: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    specs: Sequence[Arima],
    freq: str,
) -> DataFrame:
    """Forecast the rows of ``future``; same columns as ``forecast_regressions``.

    ``future`` carries the predictors of the regression part, or only (key, period)
    where there are none. The error part starts from the history passed in: its last row is the
    origin, also where values are missing, and steps are counted on the calendar.
    """
    m = FREQUENCIES[freq].seasons
    by = [*keys, "model"]
    models = _variants(specs)
    renamed = _variant_fits(fits)
    # rows of missing periods have no h
    frame = fill_gaps(extended(history, future, keys), keys, freq)
    level = predict(
        frame, renamed.withColumn("inverse", F.array().cast("array<double>")), keys, models, freq,
        level=True, carry=["h"],
    )
    left = F.coalesce(F.col("actual") - F.col("mean"), F.lit(float("nan")))
    past = F.array_sort(
        F.collect_list(F.when(F.coalesce(F.col("h") == 0, F.lit(True)), F.struct("period", left.alias("v"))))
    )
    end = F.max(F.when(F.col("h") == 0, F.col("period")))
    coming = F.array_sort(
        F.collect_list(F.when(F.col("h") > 0, F.struct("h", "period", "actual", "mean")))
    )
    series = level.groupBy(*by).agg(past.alias("past"), coming.alias("coming"), end.alias("end"))
    series = series.withColumn("past", F.filter("past", lambda x: x["period"] <= F.col("end")))
    nested = nest_fits(renamed, keys, ["d", "sd", "ar", "ma", "sigma2"])
    series = series.join(nested, list(keys)).withColumn("_fit", F.col("_fits")[F.col("model")])

    @F.pandas_udf("struct<mean: array<double>, weight: array<double>>")
    def project(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for past, steps, d, D, ar, ma in pieces(batches):
            mean, weight = [None] * len(past), [None] * len(past)
            last = steps.map(max)
            groups = pd.Series(list(zip(d, D, past.str.len(), last, ar.str.len(), ma.str.len())))
            for (d_, D_, size, h, _, _), members in groups.groupby(groups).indices.items():
                for where in slices(members, size + h):
                    level = np.stack(past.iloc[where].to_numpy()).reshape(len(where), size)
                    a, b = (np.stack(c.iloc[where].to_numpy()).reshape(len(where), -1) for c in (ar, ma))
                    level, e = arma.filled(level, ~np.isnan(level), a, b, d_, D_, m)
                    path, psi = arma.ahead(level, e, a, b, d_, D_, m, h)
                    spread = np.sqrt(np.cumsum(psi**2, axis=1))
                    for i, row in enumerate(where):
                        at = np.asarray(steps.iloc[row]) - 1
                        mean[row], weight[row] = path[i][at], spread[i][at]
            yield pd.DataFrame({"mean": mean, "weight": weight})

    steps = F.transform("coming", lambda c: (period_index(c["period"], freq) - F.col("_origin")).cast("int"))
    projected = series.filter("size(coming) > 0 AND size(past) > 0").withColumn("_origin", period_index(F.col("end"), freq)).withColumn(
        "ahead",
        project("past.v", steps, "_fit.d", "_fit.sd", "_fit.ar", "_fit.ma"),
    )
    rows = projected.select(
        *keys,
        F.substring_index("model", "|", 1).alias("model"),
        F.col("_fit.sigma2").alias("sigma2"),
        F.inline(
            F.arrays_zip(
                F.col("coming"), F.col("ahead.mean").alias("error"), F.col("ahead.weight").alias("weight")
            )
        ),
    ).select(
        *by, "coming.period", "coming.h", "coming.actual",
        (F.col("coming.mean") + F.col("error")).alias("mean"), "sigma2", "weight",
    )
    return with_intervals(rows, F.sqrt("sigma2") * F.col("weight")).drop("sigma2", "weight")


def arima_residuals(
    frame: DataFrame, fits: DataFrame, keys: Sequence[str], specs: Sequence[Arima], freq: str
) -> DataFrame:
    """``(keys, model, period, actual, fitted, residual)`` of one-step errors, where they are known."""
    by = [*keys, "model"]
    models = _variants(specs)
    renamed = _variant_fits(fits)
    u = predict(fill_gaps(frame, keys, freq), renamed, keys, models, freq)
    u = u.withColumn("residual", F.coalesce(F.col("actual") - F.col("mean"), F.lit(float("nan"))))
    series = as_series(u, by, ["actual", "residual"])
    nested = nest_fits(renamed, keys, ["d", "sd", "ar", "ma"])
    series = series.join(nested, list(keys)).withColumn("_fit", F.col("_fits")[F.col("model")])

    @F.pandas_udf("array<double>")
    def errors(u: pd.Series, ar: pd.Series, ma: pd.Series) -> pd.Series:
        out = [None] * len(u)
        sizes = pd.Series(list(zip(ar.str.len(), ma.str.len())))
        for _, members in sizes.groupby(sizes).indices.items():
            for where in slices(members, u.iloc[members].str.len().max()):
                values, live = _padded(u.iloc[where].to_numpy())
                a, b = (np.stack(c.iloc[where].to_numpy()).reshape(len(where), -1) for c in (ar, ma))
                seen = live & ~np.isnan(values)
                e = arma.recursion(np.where(seen, values, 0.0), seen, a, b)[1]
                for w, row, keep, known in zip(where, e, live, seen):
                    out[w] = np.where(known, row, np.nan)[keep]
        return pd.Series(out)

    return (
        series.withColumn("e", errors("residual", "_fit.ar", "_fit.ma"))
        .select(
            *keys,
            F.substring_index("model", "|", 1).alias("model"),
            F.inline(F.arrays_zip("period", "actual", F.col("e").alias("e"))),
        )
        .filter("e IS NOT NULL AND NOT isnan(e)")
        .select(
            *by, "period", "actual", (F.col("actual") - F.col("e")).alias("fitted"),
            F.col("e").alias("residual"),
        )
    )
