"""Overlapping and gapped time intervals (problem 2).

Time is discretised into microseconds, the unit of the column type, so nothing is rounded.  Per
entity and time shard (a day) the covered units are a run-length compressed bitmap.  Bitmaps are
united first inside each map task (which shrinks hot entities before anything moves) and then,
after one shuffle by (entity, shard), in sorted order with only one open run in memory.  Set runs
inside a shard are periods, clear runs between them are gaps.

An interval may reach over any number of shards.  It is stored once, in the shard where it starts;
a later shard with activity learns how far earlier intervals reach from the running maximum over
the shards of its entity, a table with at most one row per entity and active day, and takes that
as one more run.  Only the first and last run of each shard meet those of neighbouring shards.

Defined results
---------------
* intervals with a null end, and those that end before or when they start, do not count;
* a null entity is an entity of its own;
* touching intervals form one period; repeated rows change nothing;
* a gap is reported if it is at most ``max_gap`` (inclusive);
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of the clock reading, whatever the session's zone."""
    seconds = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def wall_text(us: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss of microseconds since 1970-01-01 00:00."""
    days = F.floor(us / DAY_US).cast("long")
    sec = F.floor((us - days * DAY_US) / 1_000_000).cast("long")
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string"), F.lit("T"), two(F.floor(sec / 3600)), F.lit(":"), two(F.floor(sec / 60) % 60), F.lit(":"), two(sec % 60))


class RunBitmap:
    """A set of time units as sorted, disjoint, non-touching runs [start, end)."""

    @staticmethod
    def union(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unites runs of equal key; input and output are sorted by (key, start)."""
        if not len(key):
            return key, start, end
        # an offset per key keeps the running maximum from crossing into the next key
        fresh = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(fresh) - 1
        reach = np.empty_like(end)
        # running maximum per group: segments are handled together by ranking the ends
        rank = np.argsort(np.argsort(end, kind="stable"), kind="stable").astype(np.int64)
        top = np.maximum.accumulate(group * np.int64(len(key)) + rank)
        by_rank = np.sort(end, kind="stable")
        reach = by_rank[top - group * np.int64(len(key))]
        opens = fresh.copy()
        opens[1:] |= start[1:] > reach[:-1]
        at = np.flatnonzero(opens)
        return key[at], start[at], reach[np.r_[at[1:] - 1, len(key) - 1]]


def _shard_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the runs of each (entity, shard) inside a batch: the map-side combine."""
    for b in batches:
        if b.num_rows:
            order = pc.sort_indices(b, sort_keys=[("entity", "ascending"), ("s", "ascending")])
            b = b.take(order)
            key = b.column("entity").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            shard = b.column("shard").to_numpy()
            change = np.r_[True, (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])]
            group = np.cumsum(change) - 1
            g, s, e = RunBitmap.union(group, b.column("s").to_numpy(), b.column("e").to_numpy())
            first = np.flatnonzero(change)[g]
            yield pa.RecordBatch.from_arrays([b.column("entity").take(pa.array(first)), pa.array(shard[first]), pa.array(s), pa.array(e)], names=["entity", "shard", "s", "e"])


def _read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by (entity, shard, s), all rows of a shard in one partition: the shard's set runs, each with the end of the run before it in the shard, first and last marked.

    The run that is still open, and the last closed one, are all that is kept between batches.
    """
    held: list | None = None  # entity, shard, s, e, end of the run before (or None)
    empty = True
    for b in batches:
        if not b.num_rows:
            continue
        name, shard, s, e = b.column("entity"), b.column("shard").to_numpy(), b.column("s").to_numpy(), b.column("e").to_numpy()
        if held is not None:
            name = pa.concat_arrays([pa.array([held[0]], name.type), name])
            shard, s, e = np.r_[held[1], shard], np.r_[held[2], s], np.r_[held[3], e]
        code = name.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change = np.r_[True, (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])]
        group = np.cumsum(change) - 1
        g, rs, re = RunBitmap.union(group, s, e)
        row = np.flatnonzero(change)[g]
        new = np.r_[True, g[1:] != g[:-1]]
        before = np.r_[0, re[:-1]]
        has = ~new
        if held is not None and held[4] is not None:
            before[0], has[0] = held[4], True
        n = len(g) - 1  # the last run stays open
        held = [name[int(row[n])].as_py(), int(shard[row[n]]), int(rs[n]), int(re[n]), int(before[n]) if has[n] else None]
        if n:
            empty = False
            last = np.r_[g[1:] != g[:-1], False][:n]
            yield pa.RecordBatch.from_arrays([name.take(pa.array(row[:n])), pa.array(shard[row[:n]]), pa.array(rs[:n]), pa.array(re[:n]), pa.array(before[:n], mask=~has[:n]), pa.array(~has[:n] | last)], names=["entity", "shard", "s", "e", "before", "edge"])
    if held is not None:
        yield pa.RecordBatch.from_pydict({"entity": pa.array([held[0]], pa.string()), "shard": pa.array([held[1]], pa.int64()), "s": pa.array([held[2]], pa.int64()), "e": pa.array([held[3]], pa.int64()), "before": pa.array([held[4]], pa.int64()), "edge": pa.array([True])})


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, *, max_gap_us: int = DAY_US, shard_us: int = DAY_US) -> DataFrame:
    """(entity, kind, s, e): the continuous periods and the gaps between them, in microseconds.

    ``start`` and ``end`` are timestamp columns read as clock readings.
    """
    runs = df.where(F.col(f"`{end}`") > F.col(f"`{start}`")).select(F.col(f"`{entity}`").alias("entity"), wall_micros(F.col(f"`{start}`")).alias("s"), wall_micros(F.col(f"`{end}`")).alias("e"))
    runs = runs.select("entity", F.floor(F.col("s") / shard_us).cast("long").alias("shard"), "s", "e")
    runs = runs.mapInArrow(_shard_runs, "entity string, shard long, s long, e long")

    # how far the intervals of earlier shards reach, at each shard with activity
    by_shard = runs.groupBy("entity", "shard").agg(F.max("e").alias("e"))
    earlier = Window.partitionBy("entity").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    floor = F.col("shard") * shard_us
    reach = by_shard.withColumn("e", F.max("e").over(earlier)).where(F.col("e") >= floor).select("entity", "shard", floor.alias("s"), "e")

    runs = runs.unionByName(reach).repartition("entity", "shard").sortWithinPartitions("entity", "shard", "s")
    runs = runs.mapInArrow(_read_runs, "entity string, shard long, s long, e long, before long, edge boolean")

    gap = lambda a, b: (b > a) & (b - a <= max_gap_us)
    inner = runs.select(
        "entity",
        F.explode(F.array(
            F.when(~F.col("edge"), F.struct(F.lit("period").alias("kind"), F.col("s").alias("s"), F.col("e").alias("e"))),
            F.when(gap(F.col("before"), F.col("s")), F.struct(F.lit("gap").alias("kind"), F.col("before").alias("s"), F.col("s").alias("e"))),
        )).alias("x"),
    ).where("x is not null").select("entity", "x.kind", "x.s", "x.e")

    # the first and last run of each shard: at most two rows per entity and day
    w = Window.partitionBy("entity").orderBy("s", "e")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    edges = runs.where("edge").withColumn("reach", F.max("e").over(so_far)).withColumn("same", F.lag("shard").over(w) == F.col("shard"))
    edges = edges.withColumn("head", F.col("reach").isNull() | (F.col("s") > F.col("reach"))).withColumn("island", F.sum(F.col("head").cast("long")).over(w))
    outer = edges.groupBy("entity", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("entity", F.lit("period").alias("kind"), "s", "e")
    between = edges.where(F.col("head") & F.col("reach").isNotNull() & ~F.col("same") & gap(F.col("reach"), F.col("s"))).select("entity", F.lit("gap").alias("kind"), F.col("reach").alias("s"), F.col("s").alias("e"))
    return inner.unionByName(outer).unionByName(between)


def found(shifts: DataFrame) -> DataFrame:
    """p2_found: periods and gaps of each name, gaps up to and including 24 hours."""
    merged = merge_intervals(shifts, "name", "clock_in", "clock_out")
    return merged.select(F.col("entity").alias("name"), "kind", wall_text(F.col("s")).alias("starts_at"), wall_text(F.col("e")).alias("ends_at"))
