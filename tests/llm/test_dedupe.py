"""Copies in other dress against a plain dictionary."""

import random
import re
from collections import defaultdict

from tests.conftest import all_rows
from tidegate.llm import dedupe

SCHEMA = "rec_id long, full_name string, email string, phone string, key string, n int"


def plain(rows):
    clean = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    by = defaultdict(set)
    for r, name, a, b, *_ in rows:
        words = tuple(sorted(w for w in map(clean, re.split(r"[\s,]+", name or "")) if w))
        by[words, tuple(sorted((clean(a), clean(b))))].add(r)
    return sorted(((min(v), x) for v in by.values() for x in v if x != min(v)), key=repr)


def dress(r, s):
    s = "".join(c.upper() if r.random() < 0.3 else c for c in s)
    return r.choice([s, f" {s} ", s.replace(" ", " "), f'"{s}"', s + "​", s + "."])


def data(n, people, seed=1):
    r, rows = random.Random(seed), []
    for i in range(n):
        p = r.randrange(people) if r.random() < 0.66 else 0  # one group holds a third of all rows
        name = f"Ann{p % 7} de Vries{p}" if r.random() < 0.7 else f"De Vries{p}, Ann{p % 7}"
        mail, tel = f"a{p}@x.example", f"555 010 {p:04d}"
        if r.random() < 0.2:
            mail, tel = tel, mail
        rows.append((i + 1, dress(r, name), dress(r, mail) if p % 3 else None, dress(r, tel) if p % 5 else " ", "k", 1))
    return rows


def test_against_a_dictionary(spark):
    rows = data(3000, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert all_rows(dedupe.copies(df)) == plain(rows)


def test_split_buckets_and_hot_forms(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "HOT", 20)
    rows = data(800, 100, 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert all_rows(dedupe.copies(df, limit=40)) == plain(rows)


def test_edges(spark):
    rows = [(5, None, None, None, "", 0), (4, " ", "", "-", "", 0), (9, "José", "x", None, "", 0), (8, "jose", "x", None, "", 0), (7, "A, B", "x", "y", "", 0), (6, "b a", "Y", "X", "", 0), (6, "b a", "Y", "X", "", 0), (3, "AB", "x", "y", "", 0), (10, "z" * 100_000, None, None, "", 0), (11, "Z" * 100_000, None, None, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = set(map(tuple, dedupe.copies(df).collect()))
    assert got == {(4, 5), (6, 7), (10, 11)}
    assert dedupe.copies(df.limit(0)).count() == 0
    assert sum(r.n_copies for r in dedupe.groups(df).collect()) == len(rows)


def test_trie():
    t = dedupe.CountingTrie()
    for key, n, kept in ((b"abc", 1, 5), (b"abcdefghij", 2, 9), (b"abc", 3, 2), (b"", 1, 1), (b"abcdefgh", 1, 4)):
        t.add(key, n, kept)
    assert sorted(t.terminals()) == [(b"", 1, 1), (b"abc", 4, 2), (b"abcdefgh", 1, 4), (b"abcdefghij", 2, 9)]


def test_buckets_hold_at_most_their_limit(spark):
    """Levels of splitting; what lies together in a bucket is decided by the key alone, and one form is never split."""
    r = random.Random(4)
    keys = ["".join(r.choice("ab") for _ in range(r.randrange(1, 12))).encode() for _ in range(3000)] + [b"zzzz"] * 500
    entries = spark.createDataFrame([(bytearray(k), 1, i) for i, k in enumerate(keys)], "key binary, n long, kept long")
    rows = [(bytes(x.bucket), bytes(x.key), x.kept) for x in dedupe.radix_bucket(entries, 60).collect()]
    assert sorted(x[2] for x in rows) == list(range(3500))
    held: dict = {}
    for bucket, key, _ in rows:
        assert key.startswith(bucket)
        held.setdefault(bucket, []).append(key)
    longer = {b: [k for k in v if len(k) > len(b)] for b, v in held.items()}  # the form that is the prefix itself is one terminal
    assert all(len(v) <= 60 or len(set(v)) == 1 for v in longer.values())
    assert len({b for b, k, _ in rows if k == b"zzzz"}) == 1 and max(map(len, held)) >= 4


def test_splits_happen_at_the_size_of_the_driver_tables():
    assert dedupe.LIMIT <= 150_000 / 10
