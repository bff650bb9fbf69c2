"""Profiles per load and what moves between loads."""

from tests.conftest import all_rows
from tidegate.operators import profile

SCHEMA = "feed_no int, load_no int, phone string, ssn string, plan string, value int, mask int"


def table(spark, loads):
    rows = [(f, n, *r, 1, 1) for (f, n), rs in loads.items() for r in rs]
    return spark.createDataFrame(rows, SCHEMA)


def test_mask(spark):
    df = spark.createDataFrame([("+1 (555) 010-9999",), ("AbÉé-9",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(profile.mask(df.v)).collect()] == ["+1 (999) 999-9999", "AaAa-9", "", None]


def test_fits(spark):
    rows = [("phone", "(555) 555-1234", True), ("phone", "+1 555.555.1234", True), ("phone", "(+1) 555-555-1234", True), ("phone", "+2 5555551234", False), ("phone", "555-1234", False), ("phone", " 5555551234", False), ("phone", "5555551234 x12", False), ("ssn", "123-45-6789", True), ("ssn", "123456789", False), ("plan", "free", True), ("plan", "free ", False), ("plan", "Pro", False)]
    df = spark.createDataFrame(rows, "f string, v string, w boolean")
    got = df.select("v", profile.fits(df.f, df.v, profile.mask(df.v)).alias("g"), "w").collect()
    assert [(r.v, r.g) for r in got] == [(r.v, r.w) for r in got]


def test_findings(spark):
    ok = [(f"555555{i:04d}", f"123-45-{i:04d}", "free") for i in range(10)]
    loads = {
        (1, 1): ok,
        (1, 2): ok,
        (1, 4): [(None if i < 2 else p, "  " if i < 1 else s, "pro" if i < 3 else "free") for i, (p, s, _) in enumerate(ok)],
        (1, 5): [("5555550001", s.replace("-", ""), "PRO") for _, s, _ in ok],
        (1, 7): [(None, None, None)] * 4,
        (1, 8): ok,
        (2, 1): [(None, None, None)],
        (2, 2): ok,
    }
    got = all_rows(profile.found(table(spark, loads)))
    want = [
        (1, 4, "phone", "nulls"), (1, 4, "ssn", "nulls"), (1, 4, "plan", "mix"),
        (1, 5, "phone", "nulls"), (1, 5, "phone", "distinct"), (1, 5, "ssn", "nulls"), (1, 5, "ssn", "pattern"), (1, 5, "plan", "pattern"), (1, 5, "plan", "mix"),
        *((1, n, f, "nulls") for n in (7, 8) for f in profile.FIELDS), *((2, 2, f, "nulls") for f in profile.FIELDS),
    ]
    assert got == sorted(want, key=repr)
    assert profile.found(table(spark, {(1, 1): ok}).limit(0)).count() == 0


def test_rare_and_divergence(spark):
    rows = {(1, 1): [("5555551234", "1", "free")] * 30 + [("x", "1", "free")], (1, 2): [("x", "1", "free")] * 30 + [("5555551234", "1", "free")]}
    df = table(spark, rows)
    masks = {(r.field, r["mask"]): r.dominant for r in profile.dominant_masks(df, least_share=0.6).collect()}
    assert masks["ssn", "9"] and not masks["phone", "a"]
    moved = {r.field: round(r.distance, 4) for r in profile.mask_divergence(df).collect()}
    assert moved == {"phone": round(29 / 31, 4), "ssn": 0.0, "plan": 0.0}
    assert profile.rare_values(df.withColumn("key", df.feed_no), "key", least_share=0.6).count() == 62


def test_masks_decide_and_rare_ones_are_looked_at(spark):
    """Dominant masks are mined per column; only where the mask alone tells are its values accepted by it."""
    loads = {(1, 1): [(f"555-555-{i:04d}", f"123-45-{i:04d}", "free") for i in range(60)] + [("5555550000", "12-345-6789", "pro"), ("555-0000", "", "gold"), (None, None, None)]}
    df = table(spark, loads)
    masks = {(r.field, r["mask"]): r.dominant for r in profile.dominant_masks(df).collect()}
    assert masks["phone", "999-999-9999"] and not masks["phone", "999-9999"] and masks["plan", "aaaa"]
    got = {(r.field, r.value): (r.sound, r.fit) for r in profile.judged(df).collect()}
    assert got["phone", "555-555-0007"] == (True, True) and got["phone", "5555550000"] == (None, True) and got["phone", "555-0000"] == (None, False)
    assert got["ssn", "123-45-0003"] == (True, True) and got["ssn", "12-345-6789"] == (None, False)
    assert got["plan", "free"] == (None, True) and got["plan", "gold"] == (None, False) and got["plan", None] == (None, None)
