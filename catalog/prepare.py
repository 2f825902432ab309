"""Preparation: types, periods, joins, windows, reshaping, contract."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tspanel.functions import (
    coerce_numeric,
    format_period_label,
    parse_period_label,
    period_trunc,
    season_of,
)
from tspanel.operators.panel import (
    align_left,
    duplicate_periods,
    fill_gaps,
    future_frame,
    future_predictors,
    melt,
    panel_contract,
    resample,
    resample_mean,
)
from tspanel.operators.transform import (
    add_events,
    add_lags,
    add_seasons,
    add_split,
    after_year,
    difference,
    pct_change,
)
from tspanel.session import shared_folder, stage
from tspanel.sources import read_archive

from .registry import (
    ORDERS_GROWTH,
    ORDERS_QUARTERLY,
    SUPPLY_GROWTH,
    SUPPLY_MONTHLY,
    R,
    orders_growth,
    orders_quarterly,
    query,
    r,
    rounded,
    supply_growth,
    supply_monthly,
    table,
)

EVENTS = {"peak": dt.date(1998, 1, 1), "dip": dt.date(1999, 7, 1)}


@query(
    """
SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN '.'
  ELSE regexp_extract(props, '"k": *([0-9.]+)', 1) END AS DOUBLE) AS value FROM events""",
    name="coerce_numeric",
)
def coerce_numeric_text(spark, folder):
    events = table(spark, folder, "events")
    text = F.when(F.col("event_type") == "error", ".").otherwise(
        F.regexp_extract("props", r'"k": *([0-9.]+)', 1)
    )
    return events.select("event_id", coerce_numeric(text).alias("value"))


def _long_panel(spark, folder):
    parts = [
        ("price", "orders", "o_orderdate", F.avg(F.sqrt("o_totalprice"))),
        ("quantity", "lineitem", "l_shipdate", F.avg(F.sqrt("l_quantity"))),
        ("discount", "lineitem", "l_shipdate", F.avg(F.sqrt("l_discount"))),
        ("activity", "events", "ts", F.avg(F.sqrt(F.abs("value")))),
    ]
    panels = [
        resample(table(spark, folder, t), [], date, "month", {"value": agg}).select(
            F.lit(name).alias("series"), "period", "value"
        )
        for name, t, date, agg in parts
    ]
    out = panels[0]
    for p in panels[1:]:
        out = out.unionByName(p)
    return out


LONG = """
long AS (
  SELECT 'price' AS series, date_trunc('month', o_orderdate)::DATE AS period,
         avg(sqrt(o_totalprice)) AS value FROM orders GROUP BY 2
  UNION ALL SELECT 'quantity', date_trunc('month', l_shipdate)::DATE, avg(sqrt(l_quantity))
  FROM lineitem GROUP BY 2
  UNION ALL SELECT 'discount', date_trunc('month', l_shipdate)::DATE, avg(sqrt(l_discount))
  FROM lineitem GROUP BY 2
  UNION ALL SELECT 'activity', date_trunc('month', ts)::DATE, avg(sqrt(abs(value)))
  FROM events GROUP BY 2)"""


@query(f"WITH {LONG} SELECT series, period, {R('value', 4)} AS value FROM long")
def panel_union(spark, folder):
    return rounded(_long_panel(spark, folder), ["value"], 4)


@query(
    f"""WITH {LONG}, t AS (SELECT period, value AS price FROM long WHERE series = 'price')
SELECT t.period, {R('t.price', 4)} AS price, {R('q.value', 4)} AS quantity,
       {R('d.value', 4)} AS discount, {R('a.value', 4)} AS activity
FROM t LEFT JOIN long q ON q.period = t.period AND q.series = 'quantity'
LEFT JOIN long d ON d.period = t.period AND d.series = 'discount'
LEFT JOIN long a ON a.period = t.period AND a.series = 'activity'""",
    name="align_left",
)
def align_left_series(spark, folder):
    names = ["price", "quantity", "discount", "activity"]
    return rounded(align_left(_long_panel(spark, folder), "price", names), names, 4)


@query(
    """
WITH labels AS (
  SELECT o_orderkey, o_orderdate, year(o_orderdate) || ' Q' || quarter(o_orderdate) AS ql,
    CASE WHEN o_orderstatus = 'P' THEN 'unknown'
      ELSE year(o_orderdate) || ' ' || strftime(o_orderdate, '%b') END AS ml FROM orders)
SELECT o_orderkey, date_trunc('quarter', o_orderdate)::DATE AS quarter,
  CASE WHEN ml <> 'unknown' THEN date_trunc('month', o_orderdate)::DATE END AS month
FROM labels""",
    name="parse_period_label",
)
def parse_labels(spark, folder):
    orders = table(spark, folder, "orders")
    date = F.col("o_orderdate")
    quarter = F.concat(F.year(date).cast("string"), F.lit(" Q"), F.quarter(date).cast("string"))
    month = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(
        F.date_format(date, "yyyy MMM")
    )
    return orders.select(
        "o_orderkey",
        parse_period_label(quarter, "quarter").alias("quarter"),
        parse_period_label(month, "month").alias("month"),
    )


@query(
    """
SELECT o_orderkey, year(o_orderdate) || ' Q' || quarter(o_orderdate) AS quarter_label,
  strftime(o_orderdate, '%Y %b') AS month_label FROM orders""",
    name="format_period_label",
)
def format_labels(spark, folder):
    date = F.col("o_orderdate").cast("date")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        format_period_label(date, "quarter").alias("quarter_label"),
        format_period_label(date, "month").alias("month_label"),
    )


@query(
    """
SELECT event_id, date_trunc('month', ts)::DATE AS month,
  date_trunc('quarter', ts)::DATE AS quarter, month(ts)::INTEGER AS season FROM events""",
    name="period_trunc",
)
def truncate_period(spark, folder):
    ts = F.col("ts")
    return table(spark, folder, "events").select(
        "event_id",
        period_trunc(ts, "month").alias("month"),
        period_trunc(ts, "quarter").alias("quarter"),
        season_of(ts.cast("date"), "month").alias("season"),
    )


@query(
    f"WITH {SUPPLY_MONTHLY} SELECT key, period, {R('1 - discount')} AS paid_share FROM supply"
)
def derived_column(spark, folder):
    df = supply_monthly(spark, folder).withColumn("paid_share", 1 - F.col("discount"))
    return df.select("key", "period", r("paid_share").alias("paid_share"))


@query(
    """
SELECT l_suppkey AS key, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
WHERE year(l_shipdate) > 1999 GROUP BY 1""",
    name="filter_year",
)
def filter_after_year(spark, folder):
    late = after_year(table(spark, folder, "lineitem"), 1999, "l_shipdate")
    return late.groupBy(F.col("l_suppkey").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query(
    f"""WITH {ORDERS_QUARTERLY}
SELECT key, period, CASE WHEN period = DATE '1998-01-01' THEN 1.0 ELSE 0.0 END::DOUBLE AS peak,
  CASE WHEN period = DATE '1999-07-01' THEN 1.0 ELSE 0.0 END::DOUBLE AS dip FROM orders_q"""
)
def event_dummies(spark, folder):
    return add_events(orders_quarterly(spark, folder), EVENTS).select("key", "period", *EVENTS)


@query(
    f"""WITH {ORDERS_GROWTH}
SELECT key, period, {R('price')} AS price,
  CASE WHEN year(period) <= 1999 THEN 'train' ELSE 'test' END AS split FROM growth"""
)
def train_test_split(spark, folder):
    df = add_split(orders_growth(spark, folder), 1999)
    return df.select("key", "period", r("price").alias("price"), "split")


@query(
    """
SELECT c_nationkey AS key, date_trunc('quarter', o_orderdate)::DATE AS period,
  round(avg(sqrt(o_totalprice)), 6) AS root
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    name="resample_mean",
)
def resample_quarter_mean(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.withColumnRenamed("c_nationkey", "key")
    joined = joined.withColumn("root", F.sqrt("o_totalprice"))
    return rounded(resample_mean(joined, ["key"], "o_orderdate", "quarter", ["root"]), ["root"])


@query(
    f"""WITH {SUPPLY_GROWTH} SELECT key, period, {R('revenue', 4)} AS revenue,
  {R('quantity', 4)} AS quantity, {R('discount', 4)} AS discount FROM growth""",
    name="pct_change",
)
def percent_change(spark, folder):
    return rounded(supply_growth(spark, folder), ["revenue", "quantity", "discount"], 4)


LAGS = [("quantity", 1), ("quantity", 3), ("discount", 2), ("revenue", 12)]


@query(
    f"""WITH {SUPPLY_GROWTH} SELECT key, period, """
    + ", ".join(f"{R(f'lag({c}, {k}) OVER w', 4)} AS {c}_lag{k}" for c, k in LAGS)
    + " FROM growth WINDOW w AS (PARTITION BY key ORDER BY period)"
)
def lag_design(spark, folder):
    names = [f"{c}_lag{k}" for c, k in LAGS]
    df = add_lags(supply_growth(spark, folder), ["key"], LAGS)
    return rounded(df.select("key", "period", *names), names, 4)


@query(
    f"""WITH {SUPPLY_MONTHLY}, a AS (
  SELECT key, period, quantity - lag(quantity, 12) OVER w AS s FROM supply
  WINDOW w AS (PARTITION BY key ORDER BY period))
SELECT key, period, s - lag(s, 1) OVER w AS quantity FROM a
WINDOW w AS (PARTITION BY key ORDER BY period)""",
    name="difference",
)
def difference_seasonal(spark, folder):
    df = supply_monthly(spark, folder).select("key", "period", "quantity")
    return difference(df, ["key"], ["quantity"], 1, 1, "month")


@query(
    f"""WITH {ORDERS_GROWTH}
SELECT key, period, 'price' AS series, {R('price')} AS value FROM growth
UNION ALL SELECT key, period, 'orders', {R('orders')} FROM growth"""
)
def melt_panel(spark, folder):
    long = melt(orders_growth(spark, folder), ["key", "period"], ["price", "orders"])
    return rounded(long, ["value"])


@query(
    """
WITH d AS (SELECT o_custkey AS key, date_trunc('month', o_orderdate)::DATE AS period,
    count(*) AS n FROM orders GROUP BY 1, 2),
a AS (SELECT key, sum(n)::BIGINT AS n_rows, count(*) AS n_periods,
    sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS n_duplicated,
    min(period) AS first_period, max(period) AS last_period FROM d GROUP BY 1)
SELECT *, 0::BIGINT AS n_misaligned,
  (datediff('month', first_period, last_period) + 1 - n_periods)::BIGINT AS n_gaps,
  n_duplicated = 0 AND datediff('month', first_period, last_period) + 1 = n_periods AS is_regular
FROM a""",
    name="panel_contract",
)
def panel_contract_report(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("key"), period_trunc(F.col("o_orderdate"), "month").alias("period")
    )
    return panel_contract(orders, ["key"], "month")


@query(
    """
SELECT o_custkey AS key, date_trunc('month', o_orderdate)::DATE AS period, count(*) AS n
FROM orders GROUP BY 1, 2 HAVING count(*) > 1"""
)
def duplicated_periods(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("key"), period_trunc(F.col("o_orderdate"), "month").alias("period")
    )
    return duplicate_periods(orders, ["key"])


@query(
    """
WITH d AS (SELECT o_custkey AS key, date_trunc('month', o_orderdate)::DATE AS period,
    count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
b AS (SELECT key, min(period) AS lo, max(period) AS hi FROM d GROUP BY 1),
s AS (SELECT key, unnest(generate_series(lo, hi, INTERVAL 1 MONTH))::DATE AS period FROM b)
SELECT s.key, s.period, d.n FROM s LEFT JOIN d ON d.key = s.key AND d.period = s.period"""
)
def gap_fill(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "key")
    counts = resample(orders, ["key"], "o_orderdate", "month", {"n": F.count(F.lit(1)).cast("double")})
    return fill_gaps(counts, ["key"], "month")


@query(
    f"""WITH {SUPPLY_MONTHLY}, b AS (SELECT key, max(period) AS hi FROM supply GROUP BY 1)
SELECT key, h::INTEGER AS h, (hi + to_months(h::INTEGER))::DATE AS period
FROM b, generate_series(1, 12) AS g(h)""",
    name="future_frame",
)
def future_periods(spark, folder):
    return future_frame(supply_monthly(spark, folder), ["key"], "month", 12)


@query(
    f"""WITH {ORDERS_GROWTH}, b AS (SELECT key, max(period) AS hi FROM growth GROUP BY 1),
f AS (SELECT key, h::INTEGER AS h, (hi + to_months(3 * h::INTEGER))::DATE AS period
  FROM b, generate_series(1, 4) AS g(h))
SELECT f.key, f.h, f.period, {R('g.price')} AS price, {R('g.orders')} AS orders,
  0.0::DOUBLE AS dummy_peak
FROM f LEFT JOIN growth g ON g.key = f.key AND g.period = (f.period - INTERVAL 1 YEAR)::DATE""",
    name="future_predictors",
)
def fill_future_predictors(spark, folder):
    """The value of the year before stands in for a forecast of each predictor."""
    growth = orders_growth(spark, folder)
    naive = melt(growth, ["key", "period"], ["price", "orders"]).select(
        "key", "series", F.add_months("period", 12).alias("period"), F.col("value").alias("mean")
    )
    future = future_frame(growth, ["key"], "quarter", 4)
    out = future_predictors(future, naive, ["key"], ["price", "orders"], ["dummy_peak"])
    return rounded(out, ["price", "orders"])


@query(
    f"""WITH {ORDERS_QUARTERLY} SELECT key, period, """
    + ", ".join(
        f"CASE WHEN quarter(period) = {j} THEN 1.0 ELSE 0.0 END::DOUBLE AS season_{j}"
        for j in (2, 3, 4)
    )
    + " FROM orders_q"
)
def season_design(spark, folder):
    return add_seasons(orders_quarterly(spark, folder), "quarter").drop("price", "orders")


# -- raw files with bad lines ---------------------------------------------------------------


def raw_lines(spark, folder):
    """Lines of raw files from monthly orders per priority, some of them spoilt: (key, line)."""
    monthly = orders_by_month(spark, folder)
    day, month = F.date_format("period", "yyyy-MM-dd"), F.month("period")
    value = F.when(month == 3, "n/a").when(month == 5, ".").otherwise(F.col("n").cast("string"))
    line = F.concat_ws(",", F.when(month == 9, F.concat(day, F.lit("-x"))).otherwise(day), value, F.when(month == 7, "more"))
    twice = F.when(month == 11, F.array(line, F.concat_ws(",", day, (F.col("n") + 1).cast("string")))).otherwise(F.array(line))
    body = monthly.select("key", F.explode(twice).alias("line"))
    return monthly.select("key", F.concat(F.lit("DATE,"), "key").alias("line")).distinct().unionByName(body)


def orders_by_month(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "key")
    return orders.groupBy("key", F.trunc("o_orderdate", "month").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH monthly AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS period, count(*) AS n
  FROM orders GROUP BY 1, 2),
lines AS (SELECT series, n, CASE month(period) WHEN 3 THEN 'value' WHEN 7 THEN 'columns' WHEN 9 THEN 'date' ELSE 'kept' END AS outcome,
    month(period) AS m FROM monthly
  UNION ALL SELECT series, NULL, 'repeated', 11 FROM monthly WHERE month(period) = 11)
SELECT series, outcome, count(*) AS n_lines, CASE WHEN outcome = 'kept' THEN {R('sum(CASE WHEN m <> 5 THEN n::DOUBLE END)')} END AS total
FROM lines GROUP BY series, outcome"""
)
def archive_lines(spark, folder):
    """Files written with bad lines, read back: what every line became."""
    path = f"{shared_folder(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    lines = stage(raw_lines(spark, folder))
    # five priorities, one file each
    for i, row in enumerate(sorted(lines.select("key").distinct().collect())):
        lines.filter(F.col("key") == row.key).select("line").coalesce(1).write.text(f"{path}/{i}")
    names = spark.read.text(f"{path}/*").filter("value LIKE 'DATE,%'").select(F.col("_metadata.file_name").alias("file"), "value").collect()
    archive = read_archive(spark, f"{path}/*", {r.file: r.value.removeprefix("DATE,") for r in names})
    kept = archive.values.groupBy("series").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("value").alias("total")).withColumn("outcome", F.lit("kept"))
    lost = archive.rejected.groupBy("series", F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n_lines"))
    return rounded(kept.unionByName(lost.withColumn("total", F.lit(None).cast("double"))), ["total"])
