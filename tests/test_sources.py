import datetime as dt

import pytest
from conftest import frame, periods, table
from pyspark.sql import functions as F

from tspanel.session import stage
from tspanel.sources import (
    SeriesFile,
    read_archive,
    read_coded_folder,
    read_panel,
    read_series_folder,
    read_table,
    write_long,
    write_wide,
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "First Series.csv").write_text("DATE,AAA\n1979-01-01,1\n1981-01-01,.\n1982-01-01,2.5\n")
    (tmp_path / "b.csv").write_text("DATE,BBB\n1990-02-01,7\n")
    (tmp_path / "wide.csv").write_text("DATE,x,y\n2000-01-01,1,2\n")
    return tmp_path


def test_read_panel_marks_and_filters(spark, folder):
    files = [
        SeriesFile("a", str(folder / "First Series.csv"), after_year=1980),
        SeriesFile("b", str(folder / "b.csv")),
    ]
    got = {(r.series, r.date): r.value for r in read_panel(spark, files).collect()}
    assert got == {
        ("a", dt.date(1981, 1, 1)): None,
        ("a", dt.date(1982, 1, 1)): 2.5,
        ("b", dt.date(1990, 2, 1)): 7.0,
    }


def test_read_folders(spark, folder):
    coded = read_coded_folder(spark, str(folder))
    assert {(r.series, r.n) for r in coded.groupBy("series").agg(F.count("*").alias("n")).collect()} == {
        ("AAA", 3), ("BBB", 1)
    }
    named = read_series_folder(spark, str(folder / "*.csv")).filter("series <> 'wide'")
    assert {r.series for r in named.select("series").distinct().collect()} == {"First Series", "b"}


@pytest.mark.parametrize("freq", ["month", "quarter"])
def test_tables_round_trip(spark, tmp_path, freq):
    df = frame(spark, table(6, {"x": [1.0, 2.5, 3, 4, 5, 6e-7]}, freq=freq))
    write_wide(df, str(tmp_path / "csv"), "csv", freq)
    back = read_table(spark, str(tmp_path / "csv"), "key string, period string, x double", freq)
    assert back.exceptAll(df).count() == 0 and back.count() == 6
    write_long(df, str(tmp_path / "parquet"), partition_by=["key"])
    assert spark.read.parquet(str(tmp_path / "parquet")).filter("key = 'a'").count() == 6


def test_stage_cuts_the_plan(spark):
    df = stage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10 and spark.sparkContext.getCheckpointDir()


def test_period_helpers_cover_years():
    assert periods(5)[4] == dt.date(2001, 1, 1)


def test_archive_accounts_for_every_line(spark, tmp_path):
    files = {
        "A one.csv": "DATE,AAA\n2000-01-01,1\n2000-02-01,.\n2000-03-01,x1\n\n2000-04-01\n2000-13-01,4\n2000-05-01,5,6\n",
        "b.csv": "DATE,AAA\r\n2000-01-01,1\r\n2000-06-01,6\r\n2000-06-01,7\r\n",
        "c.csv": "DATE,ZZZ\n2001-01-01,3\n",
        "no header.csv": "2002-01-01,-2.5e1\n2002-02-01,\n",
        "wide.csv": "DATE,x,y\n2000-01-01,1,2\n",
        "empty.csv": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    codes = {"A one.csv": "AAA", "b.csv": "AAA", "c.csv": "CCC", "no header.csv": "DDD", "empty.csv": "EEE"}
    got = read_archive(spark, str(tmp_path), codes)
    day = dt.date
    assert {(r.series, r.date): r.value for r in got.values.collect()} == {
        ("AAA", day(2000, 1, 1)): 1.0, ("AAA", day(2000, 2, 1)): None, ("AAA", day(2000, 6, 1)): 6.0,
        ("CCC", day(2001, 1, 1)): 3.0, ("DDD", day(2002, 1, 1)): -25.0, ("DDD", day(2002, 2, 1)): None,
    }
    assert sorted((r.file, r.line, r.reason) for r in got.rejected.collect()) == sorted([
        ("A one.csv", "2000-03-01,x1", "value"), ("A one.csv", "2000-04-01", "columns"), ("A one.csv", "2000-13-01,4", "date"),
        ("A one.csv", "2000-05-01,5,6", "columns"), ("b.csv", "2000-01-01,1", "repeated"), ("b.csv", "2000-06-01,7", "repeated"),
        ("c.csv", "DATE,ZZZ", "header"), ("wide.csv", "DATE,x,y", "unlisted"), ("wide.csv", "2000-01-01,1,2", "unlisted"),
    ])
    assert got.repeated.filter("kept").count() == 2 and got.repeated.count() == 4
    table = {r.file: (r.series, r["lines"], r["values"], r.rejected) for r in got.files.collect()}
    assert table == {
        "A one.csv": ("AAA", 7, 2, 4), "b.csv": ("AAA", 4, 1, 2), "c.csv": ("CCC", 2, 1, 1), "no header.csv": ("DDD", 2, 2, 0),
        "wide.csv": (None, 2, 0, 2),
    }
