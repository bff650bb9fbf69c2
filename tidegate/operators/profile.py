"""Column-level data quality profile (problem 6).

Each value is generalised to a mask of character classes (digits 9, upper-case letters A, lower-case
letters a, everything else as it is, a leading +1 as it is).  Values are counted once per load and
column with map-side combine, so a load or value with a third of all rows does not gather; every
measure is then an aggregate over those counts; the dominant masks mined from them decide which values
need to be looked at one by one.  Loads are compared with the load before them by
sending each count both to its own load and, negated, to the next one: one aggregation, no join.

Defined results
---------------
* a value is missing if null or made of spaces only; shares are over the other values, as written;
* the first load of a feed has no findings; load numbers need not be consecutive;
* a load without any value in a column has no pattern, distinct or mix finding, nor has the next one;
* repeated rows count as rows; empty tables give empty results; long values are masked whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHIFT, MIX_SHIFT = 0.0777, 0.1777
PLANS = ("free", "pro", "team", "enterprise")
FIELDS = ("phone", "ssn", "plan")


def mask(value: Column) -> Column:
    """Character-class mask: runs keep their length; a leading +1 stays, whatever parts it."""
    lead = F.regexp_extract(value, r"\A[ .\-()]*\+[ .\-()]*1", 0)
    rest = F.substring(value, F.length(lead) + 1, F.length(value))
    return F.concat(lead, F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "[0-9]", "9"), r"\p{Lu}", "A"), r"\p{Ll}", "a"))


def fits(field: Column, value: Column, mask_: Column) -> Column:
    """Whether a value keeps to its column's pattern; phones and social security numbers are judged by mask alone."""
    phone = F.regexp_replace(mask_, r"[ .\-()]", "").rlike(r"\A(?:\+1)?9{10}\z")
    return F.when(field == "phone", phone).when(field == "ssn", mask_ == "999-99-9999").otherwise(value.isin(*PLANS))


def value_counts(df: DataFrame, fields: tuple[str, ...] = FIELDS, load: tuple[str, ...] = ("feed_no", "load_no")) -> DataFrame:
    """(load columns, field, value, n): null stands for every missing value."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in fields))).alias("x")
    cells = df.select(*load, cells).select(*load, "x.field", F.when(F.trim("x.value") != "", F.col("x.value")).alias("value"))
    return cells.groupBy(*load, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def mined(counts: DataFrame, least_share: float) -> DataFrame:
    """(field, mask, n, share, dominant) of counts with masks."""
    # no filter on the values: it would go below the counts and keep their exchange from being used again
    by_mask = counts.groupBy("field", "mask").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("n")).where("n > 0")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("field"))  # a row per mask
    return by_mask.select("field", "mask", "n", share.alias("share")).withColumn("dominant", F.col("share") >= least_share)


def judged(df: DataFrame, fields: tuple[str, ...] = FIELDS, *, least_share: float = 0.05) -> DataFrame:
    """Value counts with mask and ``fit``.

    The dominant masks of each column are mined from the table.  Where such a mask alone tells that its values keep to the
    column's pattern they are accepted by mask; the values of all other masks are judged one by one."""
    counts = value_counts(df, fields).withColumn("mask", mask(F.col("value")))
    told = fits(F.col("field"), F.lit(None).cast("string"), F.col("mask"))  # null where only the value tells
    sound = mined(counts, least_share).where(F.col("dominant") & told).select("field", "mask", F.lit(True).alias("sound"))  # at most 1 / least_share masks a column
    counts = counts.join(F.broadcast(sound), ["field", "mask"], "left")
    return counts.withColumn("fit", F.coalesce("sound", fits(F.col("field"), F.col("value"), F.col("mask"))))


def profile(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per load and column: rows, missing, distinct, non-fitting, shortest and longest value, smallest and largest value."""
    counts = judged(df, fields)
    here = F.col("value").isNotNull()
    n = F.col("n")
    return counts.groupBy("feed_no", "load_no", "field").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(here, 0).otherwise(n)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
        F.sum(F.when(here & ~F.col("fit"), n).otherwise(0)).alias("n_misfit"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
    )


def mask_counts(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(feed_no, load_no, field, mask, n)."""
    counts = value_counts(df, fields).where("value is not null")
    return counts.groupBy("feed_no", "load_no", "field", mask(F.col("value")).alias("mask")).agg(F.sum("n").alias("n"))


def dominant_masks(df: DataFrame, fields: tuple[str, ...] = FIELDS, *, least_share: float = 0.05) -> DataFrame:
    """(field, mask, n, share, dominant): masks of the whole table; those below ``least_share`` are rare."""
    return mined(value_counts(df, fields).withColumn("mask", mask(F.col("value"))), least_share)


def rare_values(df: DataFrame, key: str, fields: tuple[str, ...] = FIELDS, *, least_share: float = 0.05) -> DataFrame:
    """(key, field, value, mask) of every cell whose mask is rare in its column."""
    rare = dominant_masks(df, fields, least_share=least_share).where(~F.col("dominant")).select("field", "mask")
    cells = df.select(F.col(f"`{key}`").alias("row_key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in fields))).alias("x"))
    cells = cells.select("row_key", "x.*").where(F.trim("value") != "").withColumn("mask", mask(F.col("value")))
    return cells.join(rare, ["field", "mask"], "left_semi").select("row_key", "field", "value", "mask")


def _next_loads(loads: DataFrame) -> DataFrame:
    """(feed_no, load_no, next_no): one row per load of a feed, so a window over a feed is as small as its number of loads."""
    return loads.select("feed_no", "load_no", F.lead("load_no").over(Window.partitionBy("feed_no").orderBy("load_no")).alias("next_no"))


def divergence(counts: DataFrame, loads: DataFrame, item: str) -> DataFrame:
    """(feed_no, load_no, field, distance): half the sum of absolute share differences of ``item`` to the load before, null where either has no value."""
    keys = ["feed_no", "load_no", "field"]
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    shares = counts.join(totals, keys).select(*keys, item, (F.col("n") / F.col("total")).alias("share"))
    shares = shares.join(_next_loads(loads), ["feed_no", "load_no"])
    sides = F.explode(F.array(F.struct(F.col("load_no").alias("at"), F.col("share").alias("diff"), F.lit(1).alias("own")), F.struct(F.col("next_no").alias("at"), (-F.col("share")).alias("diff"), F.lit(0).alias("own")))).alias("x")
    sides = shares.select("feed_no", "field", item, sides).select("feed_no", F.col("x.at").alias("load_no"), "field", item, "x.diff", "x.own").where("load_no is not null")
    per_item = sides.groupBy(*keys, item).agg(F.sum("diff").alias("diff"), F.max("own").alias("own"), F.min("own").alias("old"))
    moved = per_item.groupBy(*keys).agg((F.sum(F.abs("diff")) / 2).alias("distance"), F.max("own").alias("own"), F.min("old").alias("old"))
    return moved.where("own = 1 and old = 0").select(*keys, "distance")


def mask_divergence(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    return divergence(mask_counts(df, fields), df.select("feed_no", "load_no").distinct(), "mask")


def found(df: DataFrame) -> DataFrame:
    """p6_found: the loads whose profile moved against the load before of the same feed."""
    w = Window.partitionBy("feed_no", "field").orderBy("load_no")
    n_values = F.col("n_rows") - F.col("n_missing")
    p = profile(df).select(
        "feed_no", "load_no", "field",
        (F.col("n_missing") / F.col("n_rows")).alias("nulls"),
        F.when(n_values > 0, F.col("n_misfit") / n_values).alias("pattern"),
        F.when((n_values > 0) & (F.col("field") != "plan"), F.col("n_distinct") / n_values).alias("distinct"),
    )
    moved = [F.when(F.abs(F.col(k) - F.lag(k).over(w)) > SHIFT, F.lit(k)).alias(f"f_{k}") for k in ("nulls", "pattern", "distinct")]
    a = p.select("feed_no", "load_no", "field", *moved)
    a = a.select("feed_no", "load_no", "field", F.explode(F.array("f_nulls", "f_pattern", "f_distinct")).alias("finding"))
    plans = value_counts(df, ("plan",)).where("value is not null")
    mix = divergence(plans, df.select("feed_no", "load_no").distinct(), "value").where(F.col("distance") > MIX_SHIFT).select("feed_no", "load_no", "field", F.lit("mix").alias("finding"))
    return a.where("finding is not null").unionByName(mix)
