import numpy as np
import pandas as pd
import pytest
from conftest import frame, table
from pyspark.sql import functions as F

from tspanel.operators.describe import (
    autocorrelation,
    correlation_table,
    cross_correlation,
    kpss,
    longest_run,
    seasonal_strength,
    seasonal_subseries,
    stl,
)


def brute_kpss(y):
    n, e = len(y), y - y.mean()
    window = int(4 * (n / 100) ** 0.25)
    s2 = (e**2).sum() / n
    for k in range(1, window + 1):
        s2 += 2 / n * (1 - k / (window + 1)) * (e[k:] * e[:-k]).sum()
    return (np.cumsum(e) ** 2).sum() / n**2 / s2


def brute_acf(y, k):
    e = y - y.mean()
    return (e[k:] * e[:-k]).sum() / (e**2).sum()


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    series = {
        "noise": rng.normal(size=60),
        "walk": np.cumsum(rng.normal(size=200)),
        "long": rng.normal(size=1300),
    }
    data = pd.concat([table(len(v), {"value": v}, key=k, freq="month") for k, v in series.items()])
    return series, frame(spark, data).cache()


def test_kpss_matches_brute_force(panel):
    series, df = panel
    got = {r.key: r for r in kpss(df, ["key"]).collect()}
    for key, y in series.items():
        assert got[key].kpss_stat == pytest.approx(brute_kpss(y), rel=1e-9)
    assert got["walk"].kpss_p == 0.01 and got["noise"].kpss_p > 0.01


def test_acf_matches_brute_force_and_is_bounded(panel):
    series, df = panel
    for r in autocorrelation(df, ["key"], lag_max=12).collect():
        assert r.acf == pytest.approx(brute_acf(series[r.key], r.lag), abs=1e-9)
        assert -1 <= r.acf <= 1


def test_constant_short_and_null_series(spark):
    data = pd.concat(
        [
            table(10, {"value": np.full(10, 2.0)}, key="constant"),
            table(1, {"value": [1.0]}, key="one"),
            table(4, {"value": np.full(4, np.nan)}, key="null"),
        ]
    )
    df = frame(spark, data)
    assert {r.key: r.kpss_stat for r in kpss(df, ["key"]).collect()} == {"constant": None, "one": None}
    assert all(r.acf is None for r in autocorrelation(df, ["key"]).collect())
    assert stl(df, ["key"], "quarter").filter("key <> 'constant' AND status <> 'short'").count() == 0


def test_longest_run_breaks_at_nulls_and_gaps(spark):
    y = np.arange(12.0)
    y[3] = np.nan
    data = table(12, {"value": y}).drop(index=9)
    df = frame(spark, data)
    assert [r.value for r in longest_run(df, ["key"], ["value"], "quarter").orderBy("period").collect()] == [4, 5, 6, 7, 8]
    # without a frequency rows count, not periods
    assert longest_run(df, ["key"], ["value"]).count() == 7
    tie = frame(spark, table(7, {"value": [1, 2, 3, np.nan, 4, 5, 6.0]}))
    assert [r.value for r in longest_run(tie, ["key"], ["value"]).orderBy("period").collect()] == [1, 2, 3]


def test_ccf_sign_and_scale(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=80)
    y = np.r_[0, 0, x[:-2]]  # the target follows the predictor by two rows
    df = frame(spark, table(80, {"y": y, "x": x, "z": rng.normal(size=80)}))
    out = cross_correlation(df, ["key"], "y", ["x", "z"], 4)
    got = {(r.predictor, r.lag): r.ccf for r in out.collect()}
    assert max((k for k in got if k[0] == "x"), key=lambda k: got[k]) == ("x", -2)
    ey, ex = y - y.mean(), x - x.mean()
    scale = np.sqrt((ey**2).sum() * (ex**2).sum())
    assert got[("x", -2)] == pytest.approx((ey[2:] * ex[:-2]).sum() / scale)
    assert got[("x", 3)] == pytest.approx((ey[:-3] * ex[3:]).sum() / scale)
    wide = correlation_table(out, ["key"], ["x", "z"], 4)
    assert sorted(r.lag for r in wide.collect()) == [-4, -3, -2, -1, 0]


def brute_ccf(y, x, present, k):
    """Over the longest run of True in ``present``, the first of equal ones."""
    best, start = (0, 0), None
    for i, ok in enumerate([*present, False]):
        if ok and start is None:
            start = i
        elif not ok and start is not None:
            if i - start > best[0]:
                best = (i - start, start)
            start = None
    n, i = best
    ey, ex = y[i : i + n] - y[i : i + n].mean(), x[i : i + n] - x[i : i + n].mean()
    scale = np.sqrt((ey**2).sum() * (ex**2).sum())
    if abs(k) >= n or scale == 0:
        return n, None
    return n, ((ey[-k:] * ex[: n + k]).sum() if k < 0 else (ey[: n - k] * ex[k:]).sum()) / scale


def test_ccf_of_predictors_with_stretches_of_their_own(spark):
    rng = np.random.default_rng(7)
    tables, cases = [], {}
    for key in "abcd":
        data = {c: rng.normal(size=30) for c in ("y", "p", "q", "none")}
        for c in ("y", "p", "q"):
            data[c][rng.integers(0, 30, 2)] = np.nan
        data["none"][:] = np.nan
        if key == "d":
            data["p"][:] = np.nan
            data["p"][4] = 1.0
            data["y"][4] = 2.0
        tables.append(table(30, data, key=key))
        for c in ("p", "q"):
            cases[key, c] = (data["y"], data[c], ~np.isnan(data["y"]) & ~np.isnan(data[c]))
    df = frame(spark, pd.concat(tables))
    got = {(r.key, r.predictor, r.lag): (r.n, r.ccf) for r in cross_correlation(df, ["key"], "y", ["p", "q", "none"], 5).collect()}
    assert len(got) == 4 * 2 * 11
    for (key, c), (y, x, present) in cases.items():
        for k in range(-5, 6):
            n, value = brute_ccf(y, x, present, k)
            assert got[key, c, k][0] == n
            assert got[key, c, k][1] == (None if value is None else pytest.approx(value, abs=1e-12))


def test_correlation_of_many_predictors_shuffles_the_panel_once(spark):
    rng = np.random.default_rng(8)
    names = [f"p{i}" for i in range(6)]
    df = frame(spark, table(40, {c: rng.normal(size=40) for c in ("y", *names)})).repartition(3)
    long = cross_correlation(df, ["key"], "y", names, 4, "quarter")
    plan = correlation_table(long, ["key"], names, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Expand") == 0


def test_subseries_means(spark):
    df = frame(spark, table(9, {"value": np.arange(9.0)}))
    got = {r.season: r.season_mean for r in seasonal_subseries(df, ["key"], "quarter").collect()}
    assert got == {1: 4.0, 2: 3.0, 3: 4.0, 4: 5.0}


@pytest.mark.parametrize("freq,m", [("quarter", 4), ("month", 12)])
def test_stl_adds_up_and_finds_the_season(spark, freq, m):
    rng = np.random.default_rng(3)
    t = np.arange(10 * m + 3)
    season = 3 * np.sin(2 * np.pi * t / m)
    data = pd.concat(
        [
            table(len(t), {"value": 0.05 * t + season + rng.normal(0, 0.2, len(t))}, key="s", freq=freq),
            table(len(t), {"value": rng.normal(size=len(t))}, key="n", freq=freq),
        ]
    )
    parts = stl(frame(spark, data), ["key"], freq)
    off = F.abs(F.col("trend") + F.col("season") + F.col("remainder") - F.col("value"))
    assert parts.agg(F.max(off)).first()[0] < 1e-12
    got = parts.filter("key = 's'").orderBy("period").toPandas()
    assert np.abs(got["season"] - season).max() < 0.5
    strength = {r.key: r.strength for r in seasonal_strength(parts, ["key"]).collect()}
    assert strength["s"] > 0.9 and strength["n"] < 0.64


def test_stl_has_a_row_for_every_row(spark):
    """Missing months and values have no weight: the parts are near those of the whole series."""
    rng = np.random.default_rng(4)
    t = np.arange(120)
    value = 0.05 * t + 3 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 0.1, 120)
    whole = table(120, {"value": value}, freq="month")
    holes = whole.copy()
    holes.loc[[5, 40, 41, 90], "value"] = np.nan
    holes = holes.drop(index=[17, 60, 61, 62, 100])
    few = table(30, {"value": np.where(np.arange(30) < 20, 1.0, np.nan)}, key="few", freq="month")
    apart = table(400, {"value": np.where((t := np.arange(400)) % 399 < 30, 1.0, np.nan)}, key="apart", freq="month")
    df = frame(spark, pd.concat([holes, few, apart]))
    got = stl(df, ["key"], "month").toPandas()
    assert got.groupby("key").size().to_dict() == {"a": 115, "few": 30, "apart": 400}
    assert set(got[got["key"] == "few"]["status"]) == {"short"} and set(got[got["key"] == "apart"]["status"]) == {"sparse"}
    assert got[got["key"] != "a"]["trend"].isna().all()
    mine = got[got["key"] == "a"].set_index("period")
    assert (mine["status"] == "missing").sum() == 4 and mine["trend"].notna().all() and mine["season"].notna().all()
    assert mine["remainder"].isna().sum() == 4
    full = stl(frame(spark, whole), ["key"], "month").toPandas().set_index("period").loc[mine.index]
    assert (mine["season"] - full["season"]).abs().max() < 0.4 and (mine["trend"] - full["trend"]).abs().max() < 0.2


def test_stl_holds_a_slice_not_a_batch(spark, monkeypatch):
    """A batch of 6,000 series with missing values: memory within a bound, the same parts as for small batches (F2)."""
    import tracemalloc

    found, real = [], F.pandas_udf

    def spy(kind):
        return lambda f: found.append(f) or real(kind)(f)

    monkeypatch.setattr(F, "pandas_udf", spy)
    stl(frame(spark, table(30, {"value": np.arange(30.0)}, freq="month")), ["key"], "month")
    rng = np.random.default_rng(6)
    batch = pd.Series([np.where(rng.random(84) < 0.1, np.nan, rng.normal(size=84)) for _ in range(6000)])
    batch[5:7] = pd.Series([np.arange(83.0), np.arange(20.0)], index=[5, 6])
    got, peak = [], 0
    tracemalloc.start()
    for part in found[0](iter([batch])):
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        # a worker sends each part away before it asks for the next
        tracemalloc.stop()
        got.append(part.copy())
        tracemalloc.start()
    tracemalloc.stop()
    got = pd.concat(got, ignore_index=True)
    assert len(got) == 6000 and peak < 40e6, peak
    small = (batch.iloc[i : i + 7].reset_index(drop=True) for i in range(0, 700, 7))
    want = pd.concat(found[0](small), ignore_index=True)
    assert got["trend"][6] is None and want["trend"][6] is None
    for column in ("trend", "season"):
        for i in (*range(6), *range(7, 700)):
            assert np.allclose(got[column][i], want[column][i], equal_nan=True)
