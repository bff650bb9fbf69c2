"""Mixtures: the cube method's balance, caps, and shares reached."""

import numpy as np
import pytest

from tidegate.llm import mixing


def test_flight_keeps_both_totals():
    r = np.random.default_rng(5)
    n = 3000
    p, size = r.uniform(0, 1, n), r.integers(1, 2000, n).astype(float)
    q = mixing.flight(p, np.c_[np.ones(n), size], r.uniform(0, 1, n))
    free = (q > 1e-9) & (q < 1 - 1e-9)
    assert free.sum() <= 2 and q.min() >= 0 and q.max() <= 1
    assert q.sum() == pytest.approx(p.sum(), abs=1e-5) and (q * size).sum() == pytest.approx((p * size).sum(), rel=1e-7)
    landed = mixing.land(q, size)
    assert set(np.unique(landed)) <= {0.0, 1.0}
    assert abs((landed * size).sum() - (p * size).sum()) <= 4000


def test_flight_keeps_expectations():
    r = np.random.default_rng(6)
    p, size = np.array([0.3] * 20 + [0.7] * 20), r.integers(1, 50, 40).astype(float)
    total = sum(mixing.land(mixing.flight(p, np.c_[np.ones(40), size], r.uniform(0, 1, 40)), size) for _ in range(400)) / 400
    assert abs(total[:20].mean() - 0.3) < 0.04 and abs(total[20:].mean() - 0.7) < 0.04


def test_degenerate_units():
    same = np.full(10, 0.5)
    q = mixing.flight(same, np.c_[np.ones(10), np.full(10, 7.0)], np.linspace(0.05, 0.95, 10))
    assert q.sum() == pytest.approx(5) and ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2


def documents(spark, n=900):
    rows = [(i, f"word{i % 97} " * (3 + i * 7 % 40), ["big", "big", "big", "mid", "small"][i % 5] if i % 50 else None, 1) for i in range(n)] + [(10_000, None, "big", 1), (10_001, "", "mid", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("ghost", 0.05, 5)]


def test_shares_and_caps(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    for parts, block in ((3, 2000), (5, 60)):
        uses, report = mixing.mix(documents(spark).repartition(parts), targets, block=block)
        got = {r.source: r for r in report.collect()}
        assert got["ghost"].actual_share == 0 and got[None].actual_share == 0 and got[None].target_share == 0
        for s, share, cap in TARGETS[:3]:
            assert abs(got[s].actual_share - share / 0.95) < 0.01 and got[s].most_copies <= cap
        rows = uses.collect()
        assert {r.source for r in rows} == {"big", "mid", "small"} and len({r.doc_id for r in rows}) == len(rows)
        assert all(0 <= r.n_copies <= dict((s, c) for s, _, c in TARGETS)[r.source] for r in rows)
        if block == 2000:
            again = {r.doc_id: r.n_copies for r in mixing.mix(documents(spark).repartition(7), targets, block=block)[0].collect()}
            assert again == {r.doc_id: r.n_copies for r in rows}


def test_empty(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(documents(spark).limit(0), targets)
    assert uses.count() == 0 and {r.actual_share for r in report.collect()} == {0.0}
