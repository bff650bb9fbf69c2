"""Registered queries against their SQL in DuckDB, on the smallest driver tables."""

import math
import re
from collections import Counter

import pytest

import __spark_entry__ as entry

NAMES = sorted(entry.oracle_sql())


def test_every_sql_has_its_query():
    assert set(NAMES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "priority", "status", "high", "price"] and df.count() > 0


@pytest.fixture(scope="module")
def duck(sf):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(map(text, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = Counter(tuple(map(text, r)) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want


def explain(spark, df):
    return spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", ["filter_and", "filter_or_ne", "etl_composite", "segment_named"])
def test_filters_reach_the_scan(spark, sf, name):
    plan = explain(spark, entry.queries()[name](spark, sf))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    assert len(pushed) == 1 and any(sign in pushed[0] for sign in ("Than", "EqualTo", "Or("))


@pytest.mark.parametrize("name, scans", [("route_first_match", 1), ("route_conservation", 1), ("offset_rest", 2), ("check_skip", 1)])
def test_one_scan_and_no_single_task(spark, sf, name, scans):
    plan = explain(spark, entry.queries()[name](spark, sf))
    assert len(re.findall(r"\(\d+\) Scan parquet", plan)) == scans and "CollectLimit" not in plan
