"""Linear regressions for many keys and models in one job.

Catalyst reduces the panel to sufficient statistics: per (key, model, calendar cell)
a count, the means and the covariances of the dense columns. One small row per
(key, model) then goes to a vectorised solver. Means and covariances are merged in a
stable form, so large levels do not lose digits. Models without a constant cannot be
centred: their statistics are taken from a reference value of the key and solved by
an orthogonal factor of (mean row, cell rows, within-cell factor), not by products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tspanel.functions.criteria import regression_criteria
from tspanel.functions.distributions import t_two_sided
from tspanel.operators.algebra import orthogonal, pieces, slices, sweep, triangles, unpack
from tspanel.operators.design import Design, Terms, check_names
from tspanel.operators.spec import Regression

SOLUTION = "n bigint, rank int, sse double, tss double, beta array<double>, inverse array<double>"


def statistics(design: Design, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (key, model): cells with counts and means, and the pooled scatter.

    Both aggregations are clustered by the key, as the window before them was, so
    they add no exchange.
    """
    v = [f"v{i}" for i in range(design.width)]
    pairs = [(a, b) for i, a in enumerate(v) for b in v[i:]]
    rows = rows.filter(design.complete())
    reference = []
    if design.referred:
        # the difference to a close value is exact, a mean at a large level is not
        rows = rows.withColumns({c: F.col(c) - F.col(f"r{i}") for i, c in enumerate(v)})
        reference = [F.first(f"r{i}").alias(f"r{i}") for i in range(design.width)]
    cells = (
        rows.groupBy(*keys, "model", "cell")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(f"m_{c}") for c in v],
            *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs],
            *reference,
        )
    )
    base = [F.first(f"r{i}") if design.referred else F.lit(0.0) for i in range(design.width)]
    cell = F.struct("cell", "n", F.array(*[f"m_{c}" for c in v]).alias("means"))
    return cells.groupBy(*keys, "model").agg(
        F.array_sort(F.collect_list(cell)).alias("cells"),
        F.array(*[F.sum(F.col("n") * F.col(f"c_{a}_{b}")) for a, b in pairs]).alias("scatter"),
        F.array(*base).alias("reference"),
    )


def solve_uncentred(
    terms: Terms, n: np.ndarray, means: np.ndarray, scatter: np.ndarray, reference: np.ndarray
) -> dict[str, np.ndarray]:
    """``solve_batch`` for terms without a constant; ``means`` are distances from ``reference``.

    The products of all rows are those of the stacked rows built here: one of the
    overall means, one per cell for its distance from them, and a triangular factor
    of the scatter within the cells. Only the first holds the level of the data.
    """
    batch, ind, used = len(n), terms.matrix.shape[1], means.shape[2]
    total = n.sum(axis=1)
    turn = [*range(1, used), 0]
    tall = np.broadcast_to(terms.matrix, (batch, *terms.matrix.shape))
    z = np.concatenate([tall, means[:, :, turn]], axis=2)
    centre = np.einsum("bc,bcd->bd", n, z) / total[:, None]
    within = np.zeros((batch, used, ind + used))
    inner = scatter[:, turn][:, :, turn]
    # scatter within and between the cells of the dense columns, as one triangle where nothing else varies
    spread = z - centre[:, None, :]
    if not ind:
        inner = inner + np.einsum("bc,bci,bcj->bij", n, spread, spread, optimize=True)
        spread = spread[:, :0]
    within[:, :, ind:] = triangles(inner)
    level = centre.copy()
    level[:, ind:] += reference[:, turn]
    weights = np.sqrt(n)[:, : spread.shape[1], None]
    stacked = np.concatenate([np.sqrt(total)[:, None, None] * level[:, None, :], weights * spread, within], axis=1)
    fit = orthogonal(stacked, terms.order)
    target = means[:, :, 0] - centre[:, -1:]
    return {
        "n": total,
        "rank": fit["kept"].sum(axis=1),
        "sse": fit["sse"],
        "tss": scatter[:, 0, 0] + np.einsum("bc,bc->b", n, target**2),
        "beta": fit["beta"],
        "inverse": fit["inverse"],
    }


def solve_batch(
    terms: Terms, n: np.ndarray, means: np.ndarray, scatter: np.ndarray, used: int, reference: np.ndarray
) -> dict[str, np.ndarray]:
    """Least squares for systems with common terms.

    ``n``: (systems, cells); ``means``: (systems, cells, used) with the target first,
    counted from ``reference``; ``scatter``: pooled within-cell scatter of the same columns.
    """
    if not terms.constant:
        return solve_uncentred(terms, n, means, scatter, reference)
    batch, ind = len(n), terms.matrix.shape[1]
    total = n.sum(axis=1)
    centre = np.einsum("bc,bcd->bd", n, means) / total[:, None]
    off = means - centre[:, None, :]
    shift = centre + reference
    # columns: indicators, lags, target
    dense = np.concatenate([off[:, :, 1:], off[:, :, :1]], axis=2)
    turn = [*range(1, used), 0]
    z = np.concatenate([np.broadcast_to(terms.matrix, (batch, *terms.matrix.shape)), dense], axis=2)
    gram = np.einsum("bc,bci,bcj->bij", n, z, z, optimize=True)
    gram[:, ind:, ind:] += scatter[:, turn][:, :, turn]
    swept, kept = sweep(gram, terms.order)
    p = ind + used - 1
    kept = kept[:, :p]
    beta = np.where(kept, swept[:, :p, p], np.nan)
    inverse = np.where(kept[:, :, None] & kept[:, None, :], swept[:, :p, :p], 0.0)
    back = np.broadcast_to(np.eye(p), (batch, p, p)).copy()
    for j in terms.constant:
        moved = shift[:, 1:] / terms.constant_value
        back[:, j, ind:] -= np.where(kept[:, ind:], moved, 0.0)
        level = np.nansum(np.where(kept[:, ind:], beta[:, ind:], 0) * moved, axis=1)
        beta[:, j] += shift[:, 0] / terms.constant_value - level
    inverse = back @ inverse @ back.transpose(0, 2, 1)
    sse = np.maximum(swept[:, p, p], 0.0)
    # an exact fit leaves only rounding noise
    noise = 1e-14 * np.maximum(gram[:, p, p], 0.0)
    return {
        "n": total,
        "rank": kept.sum(axis=1),
        "sse": np.where(sse <= noise, 0.0, sse),
        "tss": scatter[:, 0, 0] + np.einsum("bc,bc->b", n, (means[:, :, 0] - centre[:, :1]) ** 2),
        "beta": beta,
        "inverse": inverse,
    }


def solver(design: Design):
    terms, n_cells, width = design.terms, design.n_cells, design.width

    @F.pandas_udf(SOLUTION)
    def solve(
        batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]],
    ) -> Iterator[pd.DataFrame]:
        for model, cell, n, means, scatter, reference in pieces(batches):
            out = {k: np.empty(len(model), dtype=object) for k in ("n", "rank", "sse", "tss", "beta", "inverse")}
            for name, members in model.groupby(model).indices.items():
                used = len(terms[name].lags) + 1
                # the design of the cells and the matrix of products
                columns = terms[name].matrix.shape[1] + width
                for where in slices(members, (n_cells + columns) * columns):
                    row = np.repeat(np.arange(len(where)), [len(c) for c in cell.iloc[where]])
                    at = (row, np.concatenate(cell.iloc[where].to_numpy()))
                    counts = np.zeros((len(where), n_cells))
                    counts[at] = np.concatenate(n.iloc[where].to_numpy())
                    centres = np.zeros((len(where), n_cells, width))
                    centres[at] = np.concatenate(means.iloc[where].to_numpy()).reshape(-1, width)
                    pooled = unpack(np.stack(scatter.iloc[where].to_numpy()), width)
                    base = np.stack(reference.iloc[where].to_numpy())[:, :used]
                    fit = solve_batch(
                        terms[name], counts, centres[:, :, :used], pooled[:, :used, :used], used, base
                    )
                    for k, value in fit.items():
                        flat = value.reshape(len(where), -1) if k in ("beta", "inverse") else value
                        for i, w in enumerate(where):
                            out[k][w] = flat[i]
            kinds = {"n": "int64", "rank": "int32", "sse": "float64", "tss": "float64"}
            yield pd.DataFrame({k: v.astype(kinds.get(k, object)) for k, v in out.items()})

    return solve


def solve_statistics(design: Design, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, model, family, terms, n, rank, sse, tss, beta, inverse)``."""
    solved = stats.select(
        *keys,
        "model",
        solver(design)(
            F.col("model"),
            F.col("cells.cell"),
            F.col("cells.n"),
            F.flatten(F.col("cells.means")),
            F.col("scatter"),
            F.col("reference"),
        ).alias("s"),
    )
    names = {
        s.name: F.array(*[F.lit(t) for t in design.terms[s.name].all]).cast("array<string>")
        for s in design.models
    }
    families = {s.name: F.lit(s.family) for s in design.models}
    return solved.select(
        *keys,
        "model",
        design.by_model(families).alias("family"),
        design.by_model(names).alias("terms"),
        *[f"s.{c}" for c in ("n", "rank", "sse", "tss")],
        F.transform("s.beta", lambda b: F.when(~F.isnan(b), b)).alias("beta"),
        "s.inverse",
    )


def fit_regressions(
    train: DataFrame,
    keys: Sequence[str],
    models: Sequence[Regression],
    freq: str,
    only: DataFrame | None = None,
) -> DataFrame:
    """Fit every model for every key; one row per (key, model).

    Rows in which any column of a model is null are left out for that model alone,
    so models of one key can have different ``n``. Aliased coefficients are null and
    do not count in ``rank``. Models that differ in name only are fitted once.
    """
    check_names(models)
    same: dict[Regression, list[str]] = {}
    for s in models:
        same.setdefault(replace(s, name=""), []).append(s.name)
    if only is None and len(same) < len(models):
        design = Design([replace(s, name=names[0]) for s, names in same.items()], freq)
    else:
        design, same = Design(models, freq), {}
    rows = design.rows(train, keys, only, refer=design.referred)
    fits = solve_statistics(design, statistics(design, rows, keys), keys)
    if same:
        copies = {n[0]: F.array(*[F.lit(v) for v in n]) for n in same.values()}
        fits = fits.withColumn("model", F.explode(design.by_model(copies)))
    n, rank, sse, tss = (F.col(c) for c in ("n", "rank", "sse", "tss"))
    return fits.withColumns(
        {
            "sigma2": F.when(n > rank, sse / (n - rank)),
            "r2": F.when(tss > 0, 1 - sse / tss),
            "coef": F.map_from_arrays("terms", "beta"),
            **regression_criteria(n, rank, sse),
        }
    ).withColumn(
        "adj_r2", F.when(n > rank, 1 - (1 - F.col("r2")) * (n - 1) / (n - rank))
    )


def glance(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The fit summary without coefficients."""
    wanted = ("n", "rank", "sse", "sigma2", "r2", "adj_r2", "loglik", "aic", "aicc", "bic")
    return fits.select(*keys, "model", "family", *[c for c in wanted if c in fits.columns])


def coefficient_table(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, model, term, estimate, std_error, statistic, p_value)``."""
    with_errors = "coef_terms" in fits.columns
    terms, beta = ("coef_terms", "coef_values") if with_errors else ("terms", "beta")
    # the rank of a model with ARIMA errors includes the variance
    df = F.col("n") - F.col("rank") + (1 if with_errors else 0)
    size = F.size(terms)
    variances = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.element_at("inverse", i * size + i + 1) * F.col("sigma2"),
    )
    rows = fits.filter(size > 0).select(
        *keys,
        "model",
        df.cast("double").alias("df"),
        F.inline(
            F.arrays_zip(
                F.col(terms).alias("terms"), F.col(beta).alias("beta"), variances.alias("variance")
            )
        ),
    )
    se = F.when(F.col("beta").isNotNull() & (F.col("variance") >= 0), F.sqrt("variance"))
    return (
        rows.select(
            *keys, "model", "df", F.col("terms").alias("term"),
            F.col("beta").alias("estimate"), se.alias("std_error"),
        )
        .withColumn("statistic", F.try_divide(F.col("estimate"), F.col("std_error")))
        .withColumn("p_value", t_two_sided(F.col("statistic"), F.col("df")))
        .drop("df")
    )


def report(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coefficients next to the fit statistics and orders of their model."""
    by = [*keys, "model"]
    wanted = ("family", "orders", "n", "rank", "sigma2", "loglik", "aic", "aicc", "bic")
    head = fits.select(*by, *[c for c in wanted if c in fits.columns])
    return head.join(coefficient_table(fits, keys), by, "left")


PROFILE = (
    "base array<double>, trend double, slope array<double>, base_spread array<double>,"
    " cross_spread array<double>, slope_spread array<double>"
)


def profiles(design: Design, level: bool):
    """Turn coefficients into one value per calendar cell and one slope per dense column.

    The indicator part of a regression is constant within a cell, so predicting a row
    takes a lookup and a few products. Aliased coefficients count as 0.
    """
    terms, k = design.terms, design.width - 1

    @F.pandas_udf(PROFILE)
    def profile(
        batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]],
    ) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PROFILE.split(",")]
        for model, beta, inverse in pieces(batches):
            out = {c: [None] * len(model) for c in names}
            for name, members in model.groupby(model).indices.items():
                t = terms[name]
                ind, used = len(t.names), len(t.lags)
                cells = (t.level if level else t.matrix).copy()
                drift = level and "drift" in t.names
                if drift:
                    cells[:, 0] = 0.0
                for where in slices(members, (len(cells) + ind + used) * (ind + k)):
                    b = np.stack(beta.iloc[where].to_numpy()).astype(float).reshape(len(where), -1)
                    b = np.nan_to_num(b)
                    trend = b[:, 0] if drift else np.zeros(len(where))
                    # an ARIMA fit passes no inverse: its forecasts have their own variance
                    v = np.zeros((len(where), ind + used, ind + used))
                    for i, w in enumerate(where):
                        if len(inverse.iloc[w]) == v[i].size:
                            v[i] = np.reshape(inverse.iloc[w], v[i].shape)
                    slope = np.zeros((len(where), k))
                    slope[:, :used] = b[:, ind:]
                    cross = np.zeros((len(where), len(cells), k))
                    cross[:, :, :used] = cells @ v[:, :ind, ind:]
                    spread = np.zeros((len(where), k, k))
                    spread[:, :used, :used] = v[:, ind:, ind:]
                    values = (
                        b[:, :ind] @ cells.T, trend, slope,
                        np.einsum("ci,bij,cj->bc", cells, v[:, :ind, :ind], cells, optimize=True),
                        cross.reshape(len(where), -1), spread.reshape(len(where), -1),
                    )
                    for c, rows in zip(names, values):
                        for row, w in zip(rows, where):
                            out[c][w] = row
            yield pd.DataFrame(out)

    return profile


def nest_fits(
    fits: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "_fits"
) -> DataFrame:
    """One row per key with a map from model to its fit, for a join on the key alone.

    Joining on the key keeps the partitioning of the panel, where a join on (key,
    model) would shuffle it. The map has one entry per model of the job.
    """
    entry = F.struct(F.col("model"), F.struct(*columns).alias("fit"))
    return fits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def predict(
    frame: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    models: Sequence[Regression],
    freq: str,
    level: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(keys, model, period, carry, actual, mean, leverage, sigma2)`` for every row and model.

    Lags are built over the whole frame; filter by period afterwards. Rows with a
    null regressor keep a null mean.
    """
    design = Design(models, freq)
    wanted = fits.filter(F.col("model").isin([s.name for s in models]))
    shaped = wanted.withColumn("_p", profiles(design, level)("model", "beta", "inverse"))
    nested = nest_fits(shaped, keys, ["_p.*", "sigma2"])
    rows = design.rows(frame, keys, level=level, carry=carry).join(nested, list(keys))
    rows = rows.withColumn("_fit", F.col("_fits")[F.col("model")]).filter("_fit is not null")
    fit = F.col("_fit")
    return rows.select(
        *keys,
        "model",
        "period",
        *carry,
        F.col("v0").alias("actual"),
        design.level(fit).alias("mean"),
        design.leverage(fit).alias("leverage"),
        fit["sigma2"].alias("sigma2"),
    )


def residuals(
    frame: DataFrame, fits: DataFrame, keys: Sequence[str], models: Sequence[Regression], freq: str
) -> DataFrame:
    """``(keys, model, period, actual, fitted, residual)`` on the rows used in the fit."""
    return (
        predict(frame, fits, keys, models, freq)
        .filter("actual is not null and mean is not null")
        .select(
            *keys, "model", "period", "actual", F.col("mean").alias("fitted"),
            (F.col("actual") - F.col("mean")).alias("residual"),
        )
    )
