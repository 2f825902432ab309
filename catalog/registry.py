"""Registration of queries and the panels they share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tspanel.operators.panel import resample
from tspanel.operators.transform import pct_change

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its own or the given name, with the SQL to compare it with."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def R(expression: str, digits: int = 6) -> str:
    # adding zero turns -0.0 into 0.0
    return f"(round({expression}, {digits}) + 0.0)"


# -- shared panels --------------------------------------------------------------------


def orders_quarterly(spark: SparkSession, folder: str) -> DataFrame:
    """Five keys: order priority, per quarter."""
    return resample(
        table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "key"),
        ["key"],
        "o_orderdate",
        "quarter",
        {"price": F.sum("o_totalprice"), "orders": F.count(F.lit(1)).cast("double")},
    )


ORDERS_QUARTERLY = """
orders_q AS (
  SELECT o_orderpriority AS key, date_trunc('quarter', o_orderdate)::DATE AS period,
         sum(o_totalprice) AS price, count(*)::DOUBLE AS orders
  FROM orders GROUP BY 1, 2)"""


def orders_growth(spark: SparkSession, folder: str) -> DataFrame:
    return pct_change(orders_quarterly(spark, folder), ["key"], ["price", "orders"], "price")


ORDERS_GROWTH = ORDERS_QUARTERLY + """,
orders_all AS (
  SELECT key, period, (price / lag(price) OVER w - 1) * 100 AS price,
         (orders / lag(orders) OVER w - 1) * 100 AS orders
  FROM orders_q WINDOW w AS (PARTITION BY key ORDER BY period)),
growth AS (SELECT * FROM orders_all WHERE price IS NOT NULL)"""


def supply_monthly(
    spark: SparkSession, folder: str, before: dt.date | None = None
) -> DataFrame:
    """One key per supplier, per month: the number of keys grows with the data.

    ``before`` bounds the raw dates, at the scan.
    """
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_suppkey", "key")
    if before is not None:
        lines = lines.filter(F.col("l_shipdate") < F.lit(before))
    return resample(
        lines,
        ["key"],
        "l_shipdate",
        "month",
        {
            "revenue": F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))),
            "quantity": F.sum("l_quantity"),
            "discount": F.avg(F.sqrt("l_discount")),
        },
    )


SUPPLY_MONTHLY = """
supply AS (
  SELECT l_suppkey AS key, date_trunc('month', l_shipdate)::DATE AS period,
         sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity) AS quantity,
         avg(sqrt(l_discount)) AS discount
  FROM lineitem GROUP BY 1, 2)"""


def supply_growth(
    spark: SparkSession, folder: str, before: dt.date | None = None
) -> DataFrame:
    columns = ["revenue", "quantity", "discount"]
    return pct_change(supply_monthly(spark, folder, before), ["key"], columns, "revenue")


SUPPLY_GROWTH = SUPPLY_MONTHLY + """,
supply_all AS (
  SELECT key, period,
         (revenue / nullif(lag(revenue) OVER w, 0) - 1) * 100 AS revenue,
         (quantity / nullif(lag(quantity) OVER w, 0) - 1) * 100 AS quantity,
         (discount / nullif(lag(discount) OVER w, 0) - 1) * 100 AS discount
  FROM supply WINDOW w AS (PARTITION BY key ORDER BY period)),
growth AS (SELECT * FROM supply_all WHERE revenue IS NOT NULL)"""
