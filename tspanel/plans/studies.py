"""Four ready-made studies of public economic series.

Fixed values: series codes, periods, lags and orders define the studies and have to
be exactly these for the results to be comparable.
"""

from __future__ import annotations

import datetime as dt

from tspanel.operators.spec import Arima, Lag, Pulse, Regression
from tspanel.plans.prepare import Source, Study

QUARTERS = {
    "dummy_2008Q1": dt.date(2008, 1, 1),
    "dummy_2008Q2": dt.date(2008, 4, 1),
    "dummy_2008Q3": dt.date(2008, 7, 1),
    "dummy_2008Q4": dt.date(2008, 10, 1),
    "dummy_2020Q1": dt.date(2020, 1, 1),
    "dummy_2020Q2": dt.date(2020, 4, 1),
}
CRISIS = {n: d for n, d in QUARTERS.items() if d.year == 2008}


def lags(*pairs: tuple[str, int]) -> tuple[Lag, ...]:
    return tuple(Lag(c, k) for c, k in pairs)


def pulses(events: dict[str, dt.date]) -> tuple[Pulse, ...]:
    return tuple(Pulse(n, d) for n, d in events.items())


def regressions(target: str, events: dict, table: dict) -> tuple[Regression, ...]:
    return tuple(
        Regression(name, target, season=True, lags=lags(*pairs), pulses=pulses(events))
        for name, pairs in table.items()
    )


def arima(name, target, events, pairs=(), orders=None, seasonal=None, family="arima", **kw):
    """``orders`` is (p, d, q) and ``seasonal`` (P, D, Q); None leaves a part automatic."""
    p, d, q = orders or (None, None, None)
    P, D, Q = seasonal or (None, None, None)
    return Arima(
        name, target, p, d, q, P, D, Q, lags=lags(*pairs), pulses=pulses(events),
        family=family, **kw,
    )


SEASONS = {"season": True, "intercept": True}
ALL_SEASONS = {"season": True, "intercept": False}

# -- growth of real output, quarterly -------------------------------------------------

G, I, C, S = "govt_exp", "investment", "pce", "sent"


def gdp_error(name, pairs, orders=None, seasonal=None, **kw):
    return arima(name, "real_gdp", QUARTERS, pairs, orders, seasonal, "tslm_arima", **kw)


def gdp_arima(name, orders=None, seasonal=None, **kw):
    return arima(name, "real_gdp", QUARTERS, (), orders, seasonal, **kw)


GDP_LM = regressions(
    "real_gdp",
    QUARTERS,
    {
        "lm_1": [(G, 6), (I, 5)],
        "lm_2": [(G, 6), (I, 5), (C, 7)],
        "lm_3": [(G, 7), (I, 5), (G, 6)],
        "lm_4": [(G, 6), (I, 5), (C, 7)],
        "lm_5": [(G, 1), (I, 1), (C, 2)],
        "lm_6": [(G, 1), (I, 1)],
        "lm_7": [(G, 1), (I, 1), (C, 3), (S, 2)],
    },
)
GDP_BEST = Regression(
    "lm_1", "real_gdp", season=True, lags=lags((G, 1), (I, 1)), pulses=pulses(QUARTERS)
)
GDP = Study(
    name="gdp",
    freq="quarter",
    target="real_gdp",
    sources=(
        Source("real_gdp", "ND000334Q"),
        Source("IR", "FEDFUNDS"),
        Source("investment", "NA000335Q"),
        Source("pce", "PCE"),
        Source("govt_exp", "NA000283Q"),
        Source("sent", "UMCSENT", after_year=1980),
    ),
    columns=("real_gdp", "IR", "investment", "pce", "govt_exp", "sent"),
    events=QUARTERS,
    regressions=GDP_LM,
    regression_errors=(
        gdp_error("lm_arima_1", [(G, 7), (I, 5), (G, 6)], **SEASONS),
        gdp_error("lm_arima_2", [(G, 7), (I, 5), (G, 6)], (1, 0, 2), (2, 0, 1), **ALL_SEASONS),
        gdp_error("lm_arima_3", [(G, 7), (I, 5), (G, 6)], (1, 0, 3), (2, 0, 0), **ALL_SEASONS),
        gdp_error("lm_arima_4", [(G, 1), (I, 1), (C, 2)], **SEASONS),
        gdp_error("lm_arima_5", [(G, 1), (I, 1)], ((0, 1), 0, (0, 2)), ((0, 2), 0, (0, 2)), **ALL_SEASONS),
    ),
    arima=(
        gdp_arima("auto"),
        gdp_arima("auto_s"),
        gdp_arima("arima_p", (1, 0, 1), (0, 0, 0), **ALL_SEASONS),
        gdp_arima("arima002001", (1, 0, 2), (1, 0, 1), **ALL_SEASONS),
        gdp_arima("arima202202", (1, 0, 0), (1, 0, 1), **ALL_SEASONS),
        gdp_arima("arima111", (1, 1, 1), **ALL_SEASONS),
        gdp_arima("arima010", (0, 1, 0), **ALL_SEASONS),
        gdp_arima("arima_seasonal", None, (1, 0, 1), **ALL_SEASONS),
        gdp_arima("arima_complex", (2, 0, 2), (2, 0, 2), **ALL_SEASONS),
        gdp_arima("arima_stepwise_off"),
        gdp_arima("arima_non_seasonal", (0, 0, 2), **ALL_SEASONS),
        gdp_arima("arima_seasonal_adjust", (2, 0, 2), (1, 0, 1), **ALL_SEASONS),
    ),
    finalists=(
        GDP_BEST,
        gdp_error("lm_arima_1", [(G, 1), (I, 1), (C, 2)], **SEASONS),
        gdp_arima("auto", **SEASONS),
    ),
    winner=GDP_BEST,
    future=(G, I),
    h=4,
)

# -- consumer price inflation, monthly ------------------------------------------------

OIL, PPI = "Oil_Prices", "PPI"


def cpi_error(name, pairs, orders=None, seasonal=None, **kw):
    return arima(name, "CPI", CRISIS, pairs, orders, seasonal, "tslm_arima", **kw)


def cpi_arima(name, orders=None, seasonal=None, **kw):
    return arima(name, "CPI", CRISIS, (), orders, seasonal, **kw)


CPI_BEST = Regression(
    "lm_1", "CPI", season=True, intercept=False,
    lags=lags((OIL, 2), (PPI, 1), (OIL, 3), (PPI, 2)), pulses=pulses(CRISIS),
)
CPI = Study(
    name="cpi",
    freq="month",
    target="CPI",
    sources=(
        Source("CPI", "CPIAUCNS"),
        Source("Wage_Growth", "FRBATLWGTUMHWGO"),
        Source("PPI", "PPIACO"),
        Source("Oil_Prices", "PCU333132333132"),
        Source("Exchange_Rates", "RBUSBIS"),
        Source("Unemp_Rate", "UNRATENSA"),
    ),
    columns=("CPI", "Wage_Growth", "PPI", "Oil_Prices", "Exchange_Rates", "Unemp_Rate"),
    events=CRISIS,
    regressions=regressions(
        "CPI",
        CRISIS,
        {
            "lm_1": [(OIL, 2), (PPI, 1)],
            "lm_2": [(OIL, 2), (PPI, 1), (OIL, 3), (PPI, 2)],
            "lm_3": [(OIL, 1), (PPI, 3)],
            "lm_4": [(OIL, 1), (OIL, 2), (PPI, 1), (PPI, 2)],
        },
    ),
    regression_errors=(
        cpi_error("lm_arima_1", [(OIL, 2), (PPI, 1)], **SEASONS),
        cpi_error("lm_arima_2", [(OIL, 2), (PPI, 1)], ((0, 2), 0, (0, 2)), ((0, 1), 0, 0), **SEASONS),
    ),
    arima=(
        cpi_arima("auto"),
        cpi_arima("auto_s"),
        cpi_arima("arima_p", (0, 0, 0), ((0, 3), 1, (0, 3)), **ALL_SEASONS),
        cpi_arima("arima002001", (0, 0, 2), (0, 0, 1), **ALL_SEASONS),
        cpi_arima("arima202202", (2, 0, 0), (0, 0, 1), **ALL_SEASONS),
    ),
    finalists=(
        CPI_BEST,
        cpi_error("lm_arima_2", [(OIL, 2), (PPI, 1)], ((0, 2), 0, (0, 2)), ((0, 1), 0, 0), **ALL_SEASONS),
        cpi_arima("auto", **ALL_SEASONS),
    ),
    winner=CPI_BEST,
    future=(OIL, PPI),
    h=12,
)

# -- growth of nonresidential fixed investment, quarterly -----------------------------

TECH, HOME = "Tech_Inv", "Real_Estate_MV"


def rnfi_error(name, pairs, orders=None, seasonal=None, **kw):
    return arima(name, "RNFI", QUARTERS, pairs, orders, seasonal, "tslm_arima", **kw)


def rnfi_arima(name, orders=None, seasonal=None, **kw):
    return arima(name, "RNFI", QUARTERS, (), orders, seasonal, **kw)


RNFI = Study(
    name="rnfi",
    freq="quarter",
    target="RNFI",
    sources=(
        Source("RNFI", "ND000336Q"),
        Source("Tech_Inv", "UITITI"),
        Source("Int_Rates", "BOGZ1FL072052006Q"),
        Source("Real_Estate_MV", "HNOREMV", after_year=1960),
    ),
    columns=("RNFI", "Tech_Inv", "Int_Rates", "Real_Estate_MV"),
    events=QUARTERS,
    regressions=regressions(
        "RNFI",
        QUARTERS,
        {
            "lm_1": [(TECH, 1), (HOME, 1)],
            "lm_2": [(TECH, 5), (HOME, 2)],
            "lm_3": [(TECH, 1), (TECH, 5), (HOME, 1), (HOME, 5)],
            "lm_4": [(TECH, 1)],
            "lm_5": [(TECH, 1), (TECH, 5), (TECH, 9), (HOME, 1), (HOME, 2)],
        },
    ),
    regression_errors=(
        rnfi_error("lm_arima_1", [(TECH, 1), (HOME, 1)], **ALL_SEASONS),
        rnfi_error("lm_arima_2", [(TECH, 5), (HOME, 2)], **ALL_SEASONS),
        rnfi_error("lm_arima_3", [(TECH, 5), (HOME, 2)], (1, 0, 3), (2, 0, 0), **ALL_SEASONS),
        rnfi_error("lm_arima_4", [(TECH, 1), (HOME, 1)], (1, 0, 2), (2, 0, 1), **ALL_SEASONS),
    ),
    arima=(
        rnfi_arima("auto"),
        rnfi_arima("auto_s"),
        rnfi_arima("arima_p", (1, 0, 1), (0, 0, 0), **ALL_SEASONS),
        rnfi_arima("arima002001", (1, 0, 2), (1, 0, 1), **ALL_SEASONS),
        rnfi_arima("arima202202", (1, 0, 0), (1, 0, 1), **ALL_SEASONS),
    ),
    finalists=(
        Regression(
            "lm_1", "RNFI", season=True, intercept=False,
            lags=lags((TECH, 1), (HOME, 1), (TECH, 5), (HOME, 5)), pulses=pulses(QUARTERS),
        ),
        rnfi_error("lm_arima_1", [(TECH, 1), (HOME, 1), (TECH, 5)], **ALL_SEASONS),
        rnfi_arima("auto", **ALL_SEASONS),
    ),
    winner=Regression(
        "lm_arima_1", "RNFI", season=True,
        lags=lags((TECH, 1), (HOME, 1), (TECH, 5)), pulses=pulses(QUARTERS),
    ),
    future=(HOME, TECH),
    h=4,
)

# -- growth of average weekly earnings, monthly ---------------------------------------

PRICE, JOBS, IDLE, OUTPUT = "CPI_index", "emp_rate", "unemp_rate", "index"
THREE = [(PRICE, 5), (JOBS, 4), (IDLE, 4)]


def awe_error(name, pairs, orders=None, seasonal=None, **kw):
    return arima(name, "avg_weekly_earnings", {}, pairs, orders, seasonal, "tslm_arima", **kw)


def awe_arima(name, orders=None, seasonal=None):
    return arima(name, "avg_weekly_earnings", {}, (), orders, seasonal, **ALL_SEASONS)


EARNINGS = Study(
    name="earnings",
    freq="month",
    target="avg_weekly_earnings",
    sources=(
        Source("avg_weekly_earnings", "CEU0500000011"),
        Source("CPI_index", "CPIAUCNS"),
        Source("unemp_rate", "UNRATENSA"),
        Source("index", "IPB50001N"),
    ),
    # the unemployment rate is in percent, so this is 1 - 4.8 = -3.8: kept as defined
    derived={"emp_rate": "1 - unemp_rate"},
    columns=("avg_weekly_earnings", "CPI_index", "unemp_rate", "emp_rate", "index"),
    lag_max=24,
    regressions=regressions(
        "avg_weekly_earnings",
        {},
        {
            "lm_1": [(PRICE, 5), (JOBS, 4), (IDLE, 4)],
            "lm_2": [(PRICE, 5), (PRICE, 6), (IDLE, 4), (JOBS, 4), (JOBS, 7)],
            "lm_3": [(PRICE, 5)],
            "lm_4": [(OUTPUT, 9), (PRICE, 5), (PRICE, 2)],
            "lm_5": [(IDLE, 4)],
            "lm_6": [(OUTPUT, 9), (PRICE, 5)],
        },
    ),
    regression_errors=(
        awe_error("lm_arima_1", THREE, ((0, 3), 0, (0, 2)), ((0, 1), 0, (0, 1)), **ALL_SEASONS),
        awe_error("lm_arima_2", THREE, **ALL_SEASONS),
        awe_error("lm_arima_3", THREE, ((2, 3), 0, (0, 1)), ((0, 2), 0, (0, 1)), **ALL_SEASONS),
        awe_error("lm_arima_4", [(OUTPUT, 9), (PRICE, 5)], **SEASONS),
    ),
    arima=(
        awe_arima("auto"),
        awe_arima("auto_s"),
        awe_arima("arima_p", (0, 0, 0), ((0, 3), 0, (0, 2))),
        awe_arima("arima1", ((0, 3), 0, (0, 1)), ((0, 1), 0, (0, 1))),
        awe_arima("arima2", ((0, 2), 0, (0, 2)), ((0, 1), 0, (0, 1))),
        awe_arima("arima3", ((2, 3), 0, (0, 1)), ((0, 2), 0, (0, 1))),
    ),
    finalists=(
        Regression(
            "lm_1", "avg_weekly_earnings", season=True, lags=lags((OUTPUT, 9), (PRICE, 5))
        ),
        awe_error("lm_arima_1", [(OUTPUT, 9), (PRICE, 5)], **SEASONS),
        awe_arima("auto_s"),
    ),
    winner=awe_arima("auto_s"),
    future=(),
    h=12,
)

STUDIES = {s.name: s for s in (GDP, CPI, RNFI, EARNINGS)}
