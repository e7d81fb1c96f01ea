"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from vellum.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value) or str(value) in ("<NA>", "NaT"):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return str([plain(x) for x in value])
    if isinstance(value, str):
        return value
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([plain(x) for x in r]) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).toPandas().columns.size > 0
