"""Intervals against a plain sweep, over shards, long reaches and hot entities."""

import datetime as dt
import random

import numpy as np
import pytest

from tests.conftest import all_rows
from tidegate.operators.intervals import DAY_US, RunBitmap, found, merge_intervals

T0 = dt.datetime(2026, 3, 1)
SCHEMA = "name string, clock_in timestamp_ntz, clock_out timestamp_ntz, kind int"


def sweep(rows, max_gap=dt.timedelta(days=1)):
    out, by = [], {}
    for n, a, b, *_ in rows:
        if a is not None and b is not None and b > a:
            by.setdefault(n, []).append((a, b))
    us = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    for n, xs in by.items():
        cur = None
        for a, b in sorted(xs):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
                continue
            if cur:
                out.append((n, "period", us(cur[0]), us(cur[1])))
                if a - cur[1] <= max_gap:
                    out.append((n, "gap", us(cur[1]), us(a)))
            cur = [a, b]
        out.append((n, "period", us(cur[0]), us(cur[1])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_sweep(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(1500):
        n = r.choice(["hot", "hot", "hot", "a", "b", None, "c d"])
        a = T0 + dt.timedelta(microseconds=r.randrange(0, 20 * DAY_US, 1 if seed == 3 else 60_000_000))
        b = a + dt.timedelta(microseconds=r.choice([r.randrange(-DAY_US, DAY_US), 1, 0, 60_000_000, r.randrange(1, 3_600_000_000), 9 * DAY_US if r.random() < 0.02 else 1]))
        rows.append((n, a if r.random() > 0.02 else None, b if r.random() > 0.02 else None, 1))
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = all_rows(merge_intervals(df, "name", "clock_in", "clock_out"))
    assert got == sweep(rows)


def test_edges(spark):
    d = lambda h: T0 + dt.timedelta(hours=h)
    rows = [
        ("touch", d(1), d(2), 1), ("touch", d(2), d(3), 1), ("touch", d(27), d(28), 1), ("touch", d(52) + dt.timedelta(seconds=1), d(53), 1),
        ("long", d(-24 * 400), d(24 * 400), 1), ("long", d(5), d(6), 1), ("long", d(24 * 400), d(24 * 401), 1), ("long", d(24 * 402), d(24 * 403), 1),
        ("midnight", d(20), d(24), 1), ("midnight", d(24), d(30), 1), ("back", d(3), d(1), 1), ("none", None, d(1), 1),
    ]
    got = all_rows(merge_intervals(spark.createDataFrame(rows, SCHEMA), "name", "clock_in", "clock_out"))
    assert got == sweep(rows)
    assert [x[1] for x in got if x[0] == "touch"].count("gap") == 1


def test_found_format_and_empty(spark):
    df = spark.createDataFrame([("x", T0, T0 + dt.timedelta(hours=2), 1)], SCHEMA)
    assert all_rows(found(df)) == [("x", "period", "2026-03-01T00:00:00", "2026-03-01T02:00:00")]
    assert found(df.limit(0)).count() == 0


def test_union_of_runs():
    key = np.array([0, 0, 0, 1, 1, 2])
    k, s, e = RunBitmap.union(key, np.array([0, 1, 9, 0, 5, 3]), np.array([5, 2, 10, 4, 6, 4]))
    assert list(zip(k, s, e)) == [(0, 0, 5), (0, 9, 10), (1, 0, 4), (1, 5, 6), (2, 3, 4)]
