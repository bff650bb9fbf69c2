"""Duplicates hidden by formatting differences (problem 5).

A record's canonical bytes hold its letters and digits only, in lower case: the words of the name in
sorted order, then the two contact fields in sorted order.  Each map task counts its records in a
trie whose terminals hold the number of copies and the smallest id, so a group of a third of all rows
shrinks to one entry per Arrow batch before it moves.  The entries are stored once, and partitioned by
the leading bytes of the canonical form; a bucket that holds more than ``limit`` entries is split by
one more byte, again and again, until each fits: a level looks only at the entries of the buckets that
were too full (entries of one and the same form cannot be split and need not be:
they are one terminal).  The buckets' tries give kept id and count of every form, and each record of
a form with copies is then paired with the kept one; forms with very many copies are salted.

Defined results
---------------
* null equals blank; name words are parted by white space (no-break spaces included) or commas;
* email and phone may have changed places;
* of equal records the smallest id is kept; a row repeated with its id counts as one record;
* records without any letter or digit are copies of each other;
* very long values are compared whole; an empty table gives empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.cutting import store

STRIDE = 8
#: Entries of a bucket, which one trie holds.
LIMIT = 10_000
#: Records of a form beyond which its join is dealt over ``SALTS`` tasks; this changes the plan, not the result.
HOT, SALTS = 100_000, 64
# Fixed value: what parts the words of a name (white space, no-break spaces included, and commas), for the inside of a character class.
WORD_GAPS = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000},"
UNIT, PART = "\u001f", "\u001e"


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def canonical(name: str, first: str, second: str) -> Column:
    """Canonical bytes of a record."""
    words = F.transform(F.split(F.coalesce(F.col(f"`{name}`"), F.lit("")), f"[{WORD_GAPS}]+"), alnum)
    words = F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), UNIT)
    a, b = alnum(F.col(f"`{first}`")), alnum(F.col(f"`{second}`"))
    return F.encode(F.concat(words, F.lit(PART), F.least(a, b), F.lit(UNIT), F.greatest(a, b)), "UTF-8")


class CountingTrie:
    """A trie over byte strings, ``STRIDE`` bytes a level; terminals hold [copies, smallest id]."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, n: int, kept: int) -> None:
        node = self.root
        for i in range(0, len(key), STRIDE):
            step = key[i : i + STRIDE]
            child = node.get(step)
            if child is None:
                child = node[step] = {}
            node = child
        end = node.get(None)
        if end is None:
            node[None] = [n, kept]
        else:
            end[0] += n
            if kept < end[1]:
                end[1] = kept

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for step, child in node.items():
                if step is None:
                    yield prefix, child[0], child[1]
                else:
                    stack.append((prefix + step, child))


def _batch(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    keys, n, kept = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())], names=["key", "n", "kept"])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rec_id) to one entry per distinct key of the batch."""
    for b in batches:
        trie = CountingTrie()
        for key, rec in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            trie.add(key, 1, rec)
        yield _batch(list(trie.terminals()))


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by bucket to the counts of each bucket, one trie in memory at a time."""
    held, trie = None, CountingTrie()
    for b in batches:
        for bucket, key, n, kept in zip(*(b.column(i).to_pylist() for i in range(4))):
            if bucket != held:
                if held is not None and (rows := list(trie.terminals())):
                    yield _batch(rows)
                held, trie = bucket, CountingTrie()
            trie.add(key, n, kept)
    if rows := list(trie.terminals()):
        yield _batch(rows)


def radix_bucket(entries: DataFrame, limit: int, start: int = 1) -> DataFrame:
    """Adds ``bucket``: the shortest prefix, of ``start`` bytes or more, that no more than ``limit`` entries share.

    Every level is read from where the level before left it; only the entries of buckets that are too full go on.  Only
    prefixes that are too full reach the driver, at most entries / ``limit`` a level.  A bucket of one form is not split.
    """
    prefix = lambda d: F.substring(F.col("key"), 1, d)
    depth, here, done = start, entries, []
    while True:
        full = here.where(F.octet_length("key") > depth).groupBy(prefix(depth).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("x"), F.max("key").alias("y")).where((F.col("n") > limit) & (F.col("x") != F.col("y"))).select("p").collect()
        if not full:
            done.append(here.withColumn("bucket", prefix(depth)))
            return reduce(DataFrame.unionByName, done)
        over = prefix(depth).isin([bytes(r.p) for r in full])
        done.append(here.where(~over).withColumn("bucket", prefix(depth)))
        here = store(here.where(over))
        depth += 1


def collapse(records: DataFrame, key: str, name: str, first: str, second: str, *, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(forms, records): the canonical forms as (key, n, kept), and (key, rec_id) of every record."""
    keyed = records.where(F.col(f"`{key}`").isNotNull()).select(canonical(name, first, second).alias("key"), F.col(f"`{key}`").cast("long").alias("rec_id"))
    entries = store(keyed.mapInArrow(_count_batches, "key binary, n long, kept long"))
    buckets = radix_bucket(entries, limit).select("bucket", "key", "n", "kept").repartition("bucket").sortWithinPartitions("bucket")
    return store(buckets.mapInArrow(_count_buckets, "key binary, n long, kept long")), keyed


def copies(records: DataFrame, key: str = "rec_id", name: str = "full_name", first: str = "email", second: str = "phone", *, limit: int = LIMIT) -> DataFrame:
    """(kept_id, copy_id): the smallest id of each group with each of its other records."""
    forms, keyed = collapse(records, key, name, first, second, limit=limit)
    salts = F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    more = forms.where("n > 1").select("key", "kept", (F.col("n") > HOT).alias("hot"), F.explode(salts).alias("salt"))
    hot = more.where("hot").select(F.col("key").alias("hot_key")).distinct()
    sided = keyed.join(hot, keyed["key"] == F.col("hot_key"), "left").select("key", "rec_id", F.when(F.col("hot_key").isNotNull(), F.pmod(F.xxhash64("rec_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1)).alias("salt"))
    pairs = sided.join(more.select("key", "kept", "salt"), ["key", "salt"])
    return pairs.where(F.col("rec_id") != F.col("kept")).select(F.col("kept").alias("kept_id"), F.col("rec_id").alias("copy_id"))


def groups(records: DataFrame, key: str = "rec_id", name: str = "full_name", first: str = "email", second: str = "phone") -> DataFrame:
    """(kept_id, n_copies): one row per distinct record, with the number of records that look like it."""
    forms, _ = collapse(records, key, name, first, second)
    return forms.select(F.col("kept").alias("kept_id"), F.col("n").alias("n_copies"))
