"""Mixing sources to target weights (problem 9).

The size of a document is its number of tokens.  The mixture's total is the largest at which no source
with documents needs more than its capped number of repeats; shares of sources without documents go
to the others in proportion.  A source then needs its tokens a (usually fractional) number of times:
every document is used the whole part of it, and once more with the fraction as its inclusion
probability, drawn by the cube method.  The flight moves the probabilities of blocks of documents
through the null space of the constraints (number of documents, number of tokens) until at most two
of a block are left between 0 and 1; those of all blocks fly again, level by level, until one block
holds a source's rest, whose landing rounds it with the least miss of the token total.

Defined results
---------------
* null, empty and blank texts: null and empty ones have no tokens and are used no time; blank ones count;
* sources that are null or no target are not used and are reported with a target of zero;
* a source without documents is reported with an actual share of zero;
* repeated rows are documents of their own; ties in the landing go to the smaller document id;
* draws depend on the seed and document ids only, not on the partitioning;
* an empty table gives the targets with zero documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.cutting import cut
from tidegate.llm.tokens import count_tokens

BLOCK, SEED, EPS = 2_000, 20_240_501, 1e-9
#: Target sources that are planned; more are refused, none is left out.
MOST_SOURCES = 1_000_000


def flight(p: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Cube method: moves the probabilities ``p``, keeping each column's sum of x * p, until no more than ``x.shape[1]`` of them are fractional.

    ``u`` has a uniform number per unit.  Three fractional units are held; a null-space vector of
    their constraints gives the line on which they move, to either end in proportion, so that the
    expectation stays.
    """
    p = p.copy()
    k = x.shape[1] + 1
    held: list[int] = []
    for i in range(len(p)):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = round(p[i])
            continue
        held.append(i)
        while len(held) == k:
            a = x[held].T  # constraints by units
            if k == 3:
                v = np.cross(a[0], a[1])
                if np.abs(v).max() <= EPS * max(1.0, np.abs(a).max()):
                    v = np.linalg.svd(a)[2][-1]
            else:
                v = np.linalg.svd(a)[2][-1]
            v = v / np.abs(v).max()
            q = p[held]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(v > EPS, (1 - q) / v, np.where(v < -EPS, -q / v, np.inf)).min()
                down = np.where(v > EPS, q / v, np.where(v < -EPS, (q - 1) / v, np.inf)).min()
            q = q + up * v if u[held[-1]] * (up + down) < down else q - down * v
            p[held] = np.clip(q, 0, 1)
            held = [j for j in held if EPS < p[j] < 1 - EPS]
    out = p
    done = (out <= EPS) | (out >= 1 - EPS)
    out[done] = np.round(out[done])
    return out


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the last fractional probabilities to the choice whose token total misses the expectation least."""
    free = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if not len(free):
        return p
    p = p.copy()
    goal = (p[free] * size[free]).sum()
    best = min(range(1 << len(free)), key=lambda m: (abs(sum(size[free[j]] for j in range(len(free)) if m >> j & 1) - goal), m))
    for j, i in enumerate(free):
        p[i] = float(best >> j & 1)
    return p


def _fly(final: bool):
    """Rows sorted by (source, block): one block in memory at a time, of a size that the caller bounds."""

    def solve(rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: r[2])
        size = np.array([r[3] for r in rows], dtype=float)
        p = flight(np.array([r[4] for r in rows]), np.c_[np.ones(len(rows)), size], np.array([r[5] for r in rows]))
        if final:
            p = land(p, size)
        return [(*r[:4], float(q), r[5]) for r, q in zip(rows, p)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*solve(rows)))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.float64()), pa.array(c[5], pa.float64())], names=["source", "block", "doc_id", "n_tokens", "p", "u"])

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(6))):
                if held and held[-1][:2] != r[:2]:
                    yield out(held)
                    held = []
                held.append(r)
        if held:
            yield out(held)

    return run


FIELDS = "source string, block long, doc_id long, n_tokens long, p double, u double"


def plan_sources(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """Per target source: its tokens, its quota and how often its tokens are needed (as many rows as the target table has)."""
    have = {r.source: (r.n, r.tokens) for r in sized.join(targets.select("source"), "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
    rows = [r.asDict() for r in targets.select("source", "target_share", "max_repeats").where("source is not null").limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources: they are planned in one place")
    for r in rows:
        r["n_docs"], r["tokens"] = have.get(r["source"], (0, 0))
    live = [r for r in rows if r["tokens"] and r["target_share"] > 0 and r["max_repeats"] > 0]
    weight = sum(r["target_share"] for r in live)
    total = min((r["max_repeats"] * r["tokens"] * weight / r["target_share"] for r in live), default=0.0)
    for r in rows:
        r["quota"] = total * r["target_share"] / weight if r in live else 0.0
        need = min(r["quota"] / r["tokens"], float(r["max_repeats"])) if r in live else 0.0
        r["whole"], r["fraction"] = int(need + 1e-12), max(0.0, need - int(need + 1e-12))
    return rows


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None, *, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(uses, report): uses has doc_id, source, n_tokens and n_copies of every document of a target source; report has the shares reached."""
    spark = documents.sparkSession
    sized = cut(count_tokens(documents, path, keep=("doc_id", "source")).where("n_tokens > 0"))
    rows = plan_sources(sized, targets)
    plan = spark.createDataFrame([(r["source"], r["whole"], r["fraction"], r["n_docs"]) for r in rows], "source string, whole int, p double, n_docs long")
    docs = sized.join(plan, "source")  # Spark broadcasts the plan if its size allows it
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    blocks = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.greatest(F.lit(1), F.ceil(n / block)))
    open_docs = docs.where("p > 0").select("source", blocks(F.col("n_docs")).alias("block"), "doc_id", "n_tokens", "p", uniform.alias("u"))
    drawn = None
    largest = max((r["n_docs"] for r in rows if r["fraction"] > 0), default=0)
    while True:
        final = largest <= block
        # an explicit number keeps many blocks from being gathered into one task for their few bytes
        n_blocks = sum(-(-min(r["n_docs"], largest) // block) for r in rows if r["fraction"] > 0)
        parts = max(1, min(n_blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks // 50)))
        flown = cut(open_docs.repartition(parts, "source", "block").sortWithinPartitions("source", "block").mapInArrow(_fly(final), FIELDS))
        whole = flown.where(f"p <= {EPS} or p >= 1 - {EPS}").select("doc_id", F.round("p").cast("int").alias("extra"))
        drawn = whole if drawn is None else drawn.unionByName(whole)
        if final:
            break
        # at most two of a block fly on; the next level has that many fewer blocks
        largest = 2 * (-(-largest // block)) + 1
        n = F.lit(-(-largest // block))
        open_docs = flown.where(f"p > {EPS} and p < 1 - {EPS}").withColumn("block", F.when(n == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), n)).cast("long"))
    uses = docs.join(drawn, "doc_id", "left").select("doc_id", "source", "n_tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("n_copies"))
    return uses, report(documents, uses, targets)


def report(documents: DataFrame, uses: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of either table: target and actual share, documents and tokens used, most repeats."""
    used = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens"), F.sum((F.col("n_copies") > 0).cast("long")).alias("docs_used"), F.max("n_copies").alias("most_copies"))
    total = used.agg(F.sum("tokens").alias("total"))
    every = documents.select("source").distinct().unionByName(targets.select("source")).distinct()
    shares = every.join(targets.select(F.col("source").alias("s"), "target_share", "max_repeats"), every["source"].eqNullSafe(F.col("s")), "left").drop("s")
    shares = shares.join(used, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    return shares.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.when(F.col("total") > 0, zero("tokens") / F.col("total")).otherwise(0.0).alias("actual_share"), zero("tokens").alias("tokens_used"), zero("docs_used").alias("docs_used"), zero("most_copies").alias("most_copies"), zero("max_repeats").alias("max_repeats"))
