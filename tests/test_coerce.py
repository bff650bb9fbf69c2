"""Cells to values: layouts of moments and numbers in unusual forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidegate.coerce import parse_cell
from tidegate.lower import engine_settings


def parse(spark, kind, cells, layout=None):
    with engine_settings(spark):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", parse_cell(kind, F.col("c"), layout).alias("v"))
        return [r.v for r in df.orderBy("i").collect()]


@pytest.mark.parametrize(
    "layout, cells, want",
    [
        ("_2 Jan 2006", [" 5 Mar 2024", "5 Mar 2024", "15 Mar 2024", "  5 Mar 2024", "32 Mar 2024"], ["2024-03-05", "2024-03-05", "2024-03-15", None, None]),
        ("2006-002", ["2024-060", "2024-366", "2023-366", "2024-60"], ["2024-02-29", "2024-12-31", None, None]),
        ("2006-01-02 Z07:00", ["2024-03-01 Z", "2024-03-01 +05:30", "2024-03-01 +0530"], ["2024-03-01", "2024-03-01", None]),
    ],
)
def test_date_layouts(spark, layout, cells, want):
    assert [v and str(v) for v in parse(spark, "date", cells, layout)] == want


@pytest.mark.parametrize(
    "layout, cell",
    [("2006-01-02T15:04:05Z07:00", "2024-03-10T02:30:00Z"), ("2006-01-02T15:04:05Z07:00", "2024-03-10T02:30:00+05:30"), ("2006-01-02T15:04:05 -0700", "2024-03-10T02:30:00 -0500"), ("2006-01-02T15:04:05 MST", "2024-03-10T02:30:00 UTC"), ("2006-01-02T15:04:05-07", "2024-03-10T02:30:00+01")],
)
def test_zones_keep_the_time_as_written(spark, layout, cell):
    """A moment without zone is the wall-clock time of the text, also one that the session's zone skips."""
    assert parse(spark, "datetime", [cell, cell + "x"], layout) == [datetime.datetime(2024, 3, 10, 2, 30), None]


def test_hexadecimal_numbers(spark):
    cells = ["0x1p-2", "-0X1.8P3", "0x.8p0", "0x0p0", "0x1", "0x1.p1", "0xp1", "0xfffffffffffffp0", "1x2", "0x1p99999", "0x1p2000", "1.5", "nan1"]
    assert parse(spark, "double", cells) == [0.25, -12.0, 0.5, 0.0, None, 2.0, None, float(0xFFFFFFFFFFFFF), None, None, None, 1.5, None]
