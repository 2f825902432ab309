"""Prepared tables: written as Parquet or CSV, read back with period labels parsed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tspanel.functions import format_period_label, parse_period_label


def _store(df: DataFrame, path: str, fmt: str, freq: str | None, partition_by: Sequence[str]):
    if fmt == "csv":
        df = df.withColumn("period", format_period_label(F.col("period"), freq))
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.parquet(path)


def write_wide(df: DataFrame, path: str, fmt: str = "parquet", freq: str | None = None) -> None:
    """Store a wide table. CSV output carries period labels such as ``2002 Q2``."""
    _store(df, path, fmt, freq, ())


def write_long(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    freq: str | None = None,
    partition_by: Sequence[str] = (),
) -> None:
    """Store a long table. Partition by a low-cardinality column only (never by the
    series key of a large panel: one folder per series)."""
    _store(df, path, fmt, freq, partition_by)


def read_table(spark: SparkSession, path: str, schema: str, freq: str) -> DataFrame:
    """Read a labelled CSV table; ``schema`` names ``period`` as a string column."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.withColumn("period", parse_period_label(F.col("period"), freq))
