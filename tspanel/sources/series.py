"""Raw series files: one header line, a date column and one value column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tspanel.functions import coerce_numeric
from tspanel.session import stage

RAW_SCHEMA = "date string, value string"


@dataclass(frozen=True)
class SeriesFile:
    """One raw file and the series name it gets in the panel.

    ``after_year`` keeps only later years; the bound is a date range, so that a
    stored copy of the panel can prune on it.
    """

    series: str
    path: str
    after_year: int | None = None


def _typed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("date", F.to_date("date")).withColumn(
        "value", coerce_numeric(F.col("value"))
    )


def read_series(spark: SparkSession, file: SeriesFile) -> DataFrame:
    """``(series, date, value)`` of one file, with a fixed schema and no inference."""
    raw = spark.read.schema(RAW_SCHEMA).csv(file.path, header=True)
    df = _typed(raw).select(F.lit(file.series).alias("series"), "date", "value")
    if file.after_year is not None:
        df = df.filter(F.col("date") >= F.make_date(F.lit(file.after_year + 1), F.lit(1), F.lit(1)))
    return df


def read_panel(spark: SparkSession, files: Iterable[SeriesFile]) -> DataFrame:
    """One long panel out of a list of files."""
    return reduce(DataFrame.unionByName, [read_series(spark, f) for f in files])


def read_series_folder(spark: SparkSession, path: str) -> DataFrame:
    """One long panel out of a folder or glob; the file name (no ending) names the series.

    A single scan, whatever the number of files, for archives with too many files
    to list one by one.
    """
    raw = spark.read.schema(RAW_SCHEMA).csv(path, header=True)
    name = F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.csv(\.\w+)?$", "")
    return _typed(raw.select(name.alias("series"), "date", "value"))


def read_coded_folder(spark: SparkSession, path: str) -> DataFrame:
    """One long panel out of a folder of files whose header ``DATE,<code>`` names the series.

    Files and lines with other shapes are skipped; ``read_archive`` accounts for them. Two scans of the text, whatever the number
    of files: one for the headers (a row per file), one for the values.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.split("value", ",").alias("parts")
    )
    lines = lines.filter(F.size("parts") == 2).select(
        "file", F.col("parts")[0].alias("date"), F.col("parts")[1].alias("value")
    )
    headers = lines.filter("date = 'DATE'").select("file", F.col("value").alias("series"))
    values = lines.filter("date <> 'DATE'")
    return _typed(values.join(headers, "file").select("series", "date", "value"))


@dataclass(frozen=True)
class Archive:
    """A folder of series files as tables.

    ``values``: (series, date, value), once per series and date. ``rejected``: (file, series, line, reason),
    every line that gave no value. ``repeated``: (series, date, value, file, kept), all lines of a
    (series, date) that stands more than once. ``files``: (file, header, series, lines, values, rejected) of
    every file that is not empty.
    """

    values: DataFrame
    rejected: DataFrame
    repeated: DataFrame
    files: DataFrame


def read_archive(spark: SparkSession, path: str, codes: Mapping[str, str]) -> Archive:
    """Read a folder or glob of two-column files in one scan, and account for every line.

    ``codes`` maps a file name to the code its header ``DATE,<code>`` has to have, which is the
    series; files it does not list are rejected as a whole (reason ``unlisted``). Other reasons: ``header``
    (another code, also for the header line itself, which never is a value), ``columns`` (not two),
    ``date``, ``value`` (neither a number nor the missing marker ``.``), ``repeated`` (a line for a
    (series, date) that an earlier file name or the smaller value has already given). Blank lines do not
    count. Files of one series are merged, so that overlaps show up as repeated lines.
    """
    text = F.regexp_replace("value", "\r$", "")
    lines = spark.read.text(path).select(
        F.url_decode(F.col("_metadata.file_name")).alias("file"), F.trim(text).alias("line")
    ).filter("line <> ''")
    series = _listed(codes)
    parts = F.split("line", ",", -1)
    value = F.trim(F.get(parts, F.lit(1)))
    date = F.to_date(F.when(parts[0].rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"), F.trim(parts[0])).try_cast("date"))
    is_header = F.upper(F.trim(parts[0])) == "DATE"
    parsed = lines.withColumn("series", series).select(
        "file", "series", "line", is_header.alias("is_header"), date.alias("date"), coerce_numeric(value).alias("value"),
        F.when(F.col("series").isNull(), "unlisted")
        .when(F.size(parts) != 2, "columns")
        .when(is_header, F.when(value != F.col("series"), "header"))
        .when(date.isNull(), "date")
        .when((value != ".") & (value != "") & coerce_numeric(value).isNull(), "value")
        .alias("reason"),
    )
    parsed = stage(parsed)
    good = parsed.filter("reason IS NULL AND NOT is_header")
    order = F.struct("file", F.col("value").isNull().alias("none"), "value", "line")
    cells = good.groupBy("series", "date").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    values = cells.select("series", "date", "first.value")
    # a date that stands a thousand times is one small group: the lines are joined, not collected
    several = cells.filter("n > 1").select("series", "date", F.col("first.file").alias("f_file"), F.col("first.line").alias("f_line"))
    among = good.join(several, ["series", "date"])
    counted = among.groupBy("series", "date", "value", "file", "line", "f_file", "f_line").agg(F.count(F.lit(1)).cast("int").alias("times"))
    first = (F.col("file") == F.col("f_file")) & (F.col("line") == F.col("f_line"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).withColumn("kept", first & (F.col("copy") == 1))
    repeated = stage(each.select("series", "date", "value", "file", "line", "kept"))
    bad = parsed.filter("reason IS NOT NULL").select("file", "series", "line", "reason")
    late = repeated.filter("NOT kept").select("file", "series", "line", F.lit("repeated").alias("reason"))
    rejected = bad.unionByName(late)
    headers = F.max(F.when(F.col("is_header"), F.col("line"))).alias("header")
    counts = parsed.groupBy("file", "series").agg(headers, F.count(F.lit(1)).alias("lines"), F.sum((F.col("is_header") & F.col("reason").isNull()).cast("long")).alias("heads"))
    refused = rejected.groupBy("file").agg(F.count(F.lit(1)).alias("rejected"))
    files = counts.join(refused, "file", "left").withColumn("rejected", F.coalesce("rejected", F.lit(0).cast("long")))
    files = files.select("file", "header", "series", "lines", (F.col("lines") - F.col("heads") - F.col("rejected")).alias("values"), "rejected")
    return Archive(values, rejected, repeated.drop("line"), files)


def _listed(codes: Mapping[str, str]) -> Column:
    """The code of a file, null for files that are not listed."""
    if not codes:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col("file")]
