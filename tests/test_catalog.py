"""Every query against its SQL; queries without SQL have to give rows."""

import sys
from pathlib import Path

import pytest
from conftest import MEDIUM, SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import connect, difference  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(MEDIUM).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(MEDIUM)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, MEDIUM)
    if name in oracle_sql():
        assert difference(df, con, oracle_sql()[name]) is None
    else:
        assert df.limit(1).count() == 1


def test_entry(spark):
    assert Path(SMALL).is_dir() and entry(spark).count() > 0


def test_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
