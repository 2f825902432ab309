"""Prepared tables and published findings of the four studies, from their raw files.

Files are found by their header, so any folder with the raw series serves; set
TSPANEL_GOLDEN_DIR to use another one.
"""

import numpy as np
import pandas as pd
import pytest
from conftest import GOLDEN

from tspanel.functions import parse_period_label
from tspanel.operators.describe import cross_correlation, kpss
from tspanel.operators.forecast import forecast_regressions
from tspanel.operators.regression import fit_regressions
from tspanel.operators.score import accuracy
from tspanel.operators.transform import after_year, until_year
from tspanel.plans.prepare import prepare, prepare_long
from tspanel.plans.run import forecast, run_study
from tspanel.plans.studies import CPI, EARNINGS, GDP, RNFI, STUDIES
from tspanel.session import stage
from tspanel.sources import read_coded_folder

pytestmark = pytest.mark.skipif(not GOLDEN.is_dir(), reason="no folder with the raw series")
KEYS = ["key"]


@pytest.fixture(scope="module")
def raw(spark):
    return stage(read_coded_folder(spark, str(GOLDEN)))


@pytest.fixture(scope="module")
def wide(raw):
    # the price file of the inflation study ends in January 2024
    return {
        n: stage(prepare(raw, s).filter("period <= '2024-01-01' or key <> 'cpi'"))
        for n, s in STUDIES.items()
    }


def stored(columns):
    """The stored table whose header has exactly these columns."""
    for file in sorted(GOLDEN.glob("*.csv")):
        table = pd.read_csv(file)
        if list(table.columns) == columns:
            return table
    pytest.skip(f"no stored table with {columns}")


@pytest.mark.parametrize(
    "study,columns",
    [
        (GDP, ["real_gdp", "IR", "investment", "pce", "govt_exp", "sent"]),
        (RNFI, ["RNFI", "Tech_Inv", "Int_Rates", "Real_Estate_MV"]),
        (EARNINGS, ["avg_weekly_earnings", "CPI_index", "unemp_rate", "emp_rate", "index"]),
    ],
    ids=["gdp", "rnfi", "earnings"],
)
def test_prepared_tables_are_reproduced(spark, wide, study, columns):
    columns = [*columns, *study.events]
    want = stored(["DATE", *columns])
    labels = spark.createDataFrame([(v,) for v in want["DATE"]], "label string")
    want["period"] = [
        r.p for r in labels.select(parse_period_label(labels.label, study.freq).alias("p")).collect()
    ]
    both = want.merge(wide[study.name].toPandas(), on="period", suffixes=("", "_ours"))
    assert len(both) == len(want) == wide[study.name].count()
    for c in columns:
        assert np.allclose(both[c], both[f"{c}_ours"], atol=1e-9, equal_nan=True), c


@pytest.mark.parametrize("study", [GDP, RNFI], ids=["gdp", "rnfi"])
def test_long_tables_are_reproduced(wide, study):
    ours = prepare_long(wide[study.name], study).toPandas()
    for file in sorted(GOLDEN.glob("*.csv")):
        want = pd.read_csv(file)
        if list(want.columns) == ["DATE", "Series", "Values"] and set(want["Series"]) == set(study.columns):
            assert len(want) == len(ours)
            assert np.allclose(np.sort(want["Values"]), np.sort(ours["value"]), atol=1e-9)
            return
    pytest.skip("no stored long table")


# Published or verified results.
KPSS = {
    "gdp": {"real_gdp": 0.1, "investment": 0.1, "pce": 0.1, "govt_exp": 0.1, "sent": 0.1, "IR": 0.0912},
    "cpi": {"CPI": 0.0981, "Oil_Prices": 0.01},
    "rnfi": {"Tech_Inv": 0.0669, "Real_Estate_MV": 0.01},
    "earnings": {"avg_weekly_earnings": 0.1, "CPI_index": 0.1, "unemp_rate": 0.1, "emp_rate": 0.1, "index": 0.1},
}
AICC = {
    "gdp": [19.916, 23.482, 23.589, 23.482, -35.199, -40.130, -40.112],
    "rnfi": [85.908, 79.608, 84.873, 84.918, 48.796],
    "earnings": [162.711, 164.840, 162.247, 162.758, 163.642, 160.494],
    "cpi": [-1658.928, -1676.308, -1555.938, -1687.898],
}
RMSE = {
    "rnfi": [1.4978, 1.4531, 1.5279, 1.1704, 1.0762],
    "earnings": [1.4913, 1.5271, 1.4645, 1.4700, 1.4281, 1.4703],
    "cpi": [0.3696, 0.3458, 0.3847, 0.3623],
}


@pytest.mark.parametrize("name", sorted(STUDIES))
def test_stationarity(wide, name):
    long = prepare_long(wide[name], STUDIES[name])
    got = {r.series: r.kpss_p for r in kpss(long, ["key", "series"]).collect()}
    for series, p in KPSS[name].items():
        assert got[series] == pytest.approx(p, abs=5e-5)


@pytest.mark.parametrize("name", sorted(STUDIES))
def test_regressions_and_holdout(wide, name):
    study = STUDIES[name]
    train, test = until_year(wide[name], 2021), after_year(wide[name], 2021)
    fits = stage(fit_regressions(train, KEYS, study.regressions, study.freq))
    aicc = {r.model: r.aicc for r in fits.collect()}
    assert [aicc[f"lm_{i + 1}"] for i in range(len(AICC[name]))] == pytest.approx(AICC[name], abs=6e-4)
    out = forecast_regressions(train, test, fits, KEYS, study.regressions, study.freq)
    rmse = {r.model: r.rmse for r in accuracy(out, KEYS).collect()}
    if name == "gdp":
        assert rmse["lm_6"] == pytest.approx(0.4236, abs=6e-5)
    else:
        assert [rmse[f"lm_{i + 1}"] for i in range(len(RMSE[name]))] == pytest.approx(RMSE[name], abs=6e-5)


def test_rank_deficient_study_model(wide):
    fits = fit_regressions(until_year(wide["rnfi"], 2021), KEYS, RNFI.regressions, "quarter")
    r = fits.filter("model = 'lm_5'").first()
    assert r.rank == 11 and len(r.terms) == 15


def test_cross_correlation_of_investment(wide):
    out = cross_correlation(wide["gdp"], KEYS, "real_gdp", ["investment"], 12, "quarter")
    got = {r.lag: round(r.ccf, 2) for r in out.collect()}
    assert (got[-1], got[-9]) == (0.46, 0.47)


def test_whole_study_runs(raw):
    tables = run_study(raw, GDP)
    assert tables["aicc"].filter("rank = 1").count() == 3
    best = tables["holdout"].orderBy("rmse").first()
    assert best.model == "lm_1" and tables["holdout"].count() == 3
    assert tables["forecast"].filter("kind = 'forecast' and value is not null").count() == 4
    assert tables["ccf"].count() == 13 and tables["stl"].count() == 87


def test_monthly_forecast_with_predictors(wide):
    ahead = forecast(wide["cpi"], CPI).filter("kind = 'forecast'").toPandas()
    assert len(ahead) == 12 and ahead["value"].notna().all()
