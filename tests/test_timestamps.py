"""Timestamps: notations, zones, changes of clocks, and cells that cannot be read."""

import datetime as dt
import zoneinfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import all_rows
from tidegate.operators import timestamps as ts

CASES = [
    # cell, site zone, order, instant
    ("2024-01-01 03:50:44", "Europe/London", "DMY", "2024-01-01T03:50:44.000000Z"),
    (" 2024-07-01 03:50 ", "Europe/Berlin", "DMY", "2024-07-01T01:50:00.000000Z"),
    ("2024-01-01 03:33:19.466299+0100", None, None, "2024-01-01T02:33:19.466299Z"),
    ("2024-01-01T12:00:00−05:00", None, None, "2024-01-01T17:00:00.000000Z"),
    ("2024-01-01t11:27:41z", None, None, "2024-01-01T11:27:41.000000Z"),
    ("2024-01-02T02:12:58.490823733Z", None, None, "2024-01-02T02:12:58.490823Z"),
    ("2024-01-12 09:05:55,658", "Australia/Sydney", "DMY", "2024-01-11T22:05:55.658000Z"),
    ("20240101T111629Z", None, None, "2024-01-01T11:16:29.000000Z"),
    ("01/02/2024 4:40 PM", "America/New_York", "MDY", "2024-01-02T21:40:00.000000Z"),
    ("01/02/24 12:05 AM", "Europe/London", "DMY", "2024-02-01T00:05:00.000000Z"),
    ("04.01.2024 02:54:26", "Europe/Berlin", "DMY", "2024-01-04T01:54:26.000000Z"),
    ("2:06 pm, Jan 1 2024", "America/Sao_Paulo", "DMY", "2024-01-01T17:06:00.000000Z"),
    ("Tue, 02 Jan 2024 13:22:30 +0100", None, None, "2024-01-02T12:22:30.000000Z"),
    ("15. März 2024, 18:04 Uhr", "Europe/Berlin", "DMY", "2024-03-15T17:04:00.000000Z"),
    ("2024-01-04T08:47:11+01:00[Europe/Berlin]", None, None, "2024-01-04T07:47:11.000000Z"),
    ("2024-07-04T08:47:11[Europe/Berlin]", None, None, "2024-07-04T06:47:11.000000Z"),
    ("2024-07-04 08:47:11 Asia/Kathmandu", "Europe/Berlin", "DMY", "2024-07-04T03:02:11.000000Z"),
    ("03 Nov 2024 01:30:00 EST", "America/New_York", "MDY", "2024-11-03T06:30:00.000000Z"),
    ("03 Nov 2024 01:30:00 EDT", "America/New_York", "MDY", "2024-11-03T05:30:00.000000Z"),
    ("01 Jun 2024 12:00:00 IST", "Asia/Kolkata", "DMY", "2024-06-01T06:30:00.000000Z"),
    ("2024-10-27 02:30:00", "Europe/Berlin", "DMY", "2024-10-27T00:30:00.000000Z"),  # twice: the earlier
    ("2024-03-31 02:30:00", "Europe/Berlin", "DMY", "2024-03-31T01:30:00.000000Z"),  # skipped: offset before
    ("1704151049", None, None, "2024-01-01T23:17:29.000000Z"),
    ("1704151049451", None, None, "2024-01-01T23:17:29.451000Z"),
    ("1704151049451123", None, None, "2024-01-01T23:17:29.451123Z"),
    ("45292", "Europe/London", "DMY", "2024-01-01T00:00:00.000000Z"),
    # no cases
    ("2024-01-01 03:50:44", None, None, None),
    ("2024-01-01 03:50:44 Mars/Base", "Europe/London", "DMY", None),
    ("13/13/2024 10:00", "Europe/London", "DMY", None),
    ("2025-07-", "Europe/London", "DMY", None),
    ("00:00", "Europe/London", "DMY", None),
    ("2026-02-30 25:61:00", "Europe/London", "DMY", None),
    ("29/02/2023 10:00", "Europe/London", "DMY", None),
    ("2024-01-01 13:00 PM", "Europe/London", "DMY", None),
    ("2024-01-01T10:00:00+19:00", None, None, None),
    ("", "Europe/London", "DMY", None),
    ("  ", "Europe/London", "DMY", None),
    ("forgot", "Europe/London", "DMY", None),
    ("\u0001\u0002", "Europe/London", "DMY", None),
    ("1" * 100_000, "Europe/London", "DMY", None),
    (None, "Europe/London", "DMY", None),
]


def normal(spark, cases, as_date=False):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, cell string, zone string, o string")
    out = ts.normalise(df, "cell", day_first=F.col("o") == "DMY", zone=F.col("zone"), as_date=as_date, zones=ts.known_zones(spark), out="normal")
    assert out.columns == [*df.columns, "normal"]
    return [r.normal for r in out.orderBy("i").collect()]


def test_instants(spark):
    got = normal(spark, CASES)
    assert [(c[0], g) for c, g in zip(CASES, got)] == [(c[0], c[3]) for c in CASES]


def test_dates(spark):
    cases = [("28/10/2024", "2024-10-28"), ("2022-11-02 07:30", "2022-11-02"), ("2024-07-07T22:26:01-05:00", "2024-07-08"), ("2024-01-01T23:00:00Z", "2024-01-01"), ("1688502883636", "2023-07-04"), ("45292", "2024-01-01"), ("20241213", "2024-12-13"), ("9.3.20", "2020-03-09"), ("21. September 2025", "2025-09-21"), ("Feb 28, 2026", "2026-02-28"), ("5 May 2021", "2021-05-05"), ("2022/04/08", "2022-04-08"), ("2026-03", None), ("Q2 2025", None), ("00/00/0000", None), ("2025-06-31", None)]
    assert normal(spark, [(c, None, "DMY") for c, _ in cases], as_date=True) == [w for _, w in cases]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.datetimes(dt.datetime(1975, 1, 1), dt.datetime(2035, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kathmandu", "America/Sao_Paulo", "Africa/Casablanca"])), min_size=30, max_size=60))
def test_wall_clock_agrees_with_python(spark, pairs):
    got = normal(spark, [(t.isoformat(sep=" "), z, "DMY") for t, z in pairs])
    for (t, z), g in zip(pairs, got):
        want = t.replace(tzinfo=zoneinfo.ZoneInfo(z), fold=0).astimezone(dt.UTC)
        assert g == want.strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def test_found_over_tables(spark):
    punches = spark.createDataFrame([(1, "S", "01/02/2024 10:00", None, 7), (1, "S", "01/02/2024 10:00", None, 7), (2, None, "2024-01-01", "?", 7)], "punch_id long, site_code string, clock_in string, clock_out string, normal int")
    sites = spark.createDataFrame([("S", "UTC", "MDY")], "site_code string, zone_id string, numeric_order string")
    show = spark.createDataFrame([(5, "US", "01/02/2024"), (6, None, "01/02/2024"), (7, "EU", None)], "rec_id long, region string, signup_date string")
    terms = spark.createDataFrame([(9, "01/02/2024")], "term_id long, started_on string")
    got = all_rows(ts.found(spark, punches, sites, show, terms))
    assert got == sorted([("datetime_punches", "clock_in", 1, "2024-01-02T10:00:00.000000Z")] * 2 + [("showcase", "signup_date", 5, "2024-01-02"), ("showcase", "signup_date", 6, "2024-02-01"), ("date_terms", "started_on", 9, "2024-02-01")], key=repr)
    assert ts.found(spark, punches.limit(0), sites, show.limit(0), terms.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p1_renewed"])
def test_driver_tables(spark, sf, name):
    from tidegate.plans.problems import QUERIES

    assert QUERIES[name](spark, sf).count() > 50
