"""Every query of the catalog against its oracle, on the smallest tables."""

import math
import numbers
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from siftwright.plans import catalog
from siftwright.session import TABLES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the test tables aren't here")


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return "null"
    number = isinstance(value, numbers.Number) and not isinstance(value, (bool, np.bool_))  # a column with nulls comes as floats
    return f"{float(value):.6f}" if number else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(SF))
    if name in catalog.ORACLE_SQL:
        assert rows(got.toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())
    else:
        assert got.count() > 0
