"""Typed tables as sources: a Parquet path, or a registered view.

Options: ``order_by`` names the unique column that gives the rows their order.  Parquet without it is
in the order of its files and their rows; a view without it has no order, and what needs one (limit,
offset, error sinks, and abort where a row can fail) is refused.  The order key itself goes with the
rows.  Ordinals are looked up only for rows that failed, from a range sort of the key alone and the
sizes of its partitions, or from the sizes of the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.cutting import cut
from tidegate.lower import FAIL, FAIL_TYPE, OFF, ORD, Frame, q
from tidegate.nodes import BuildFault, SourceDecl
from tidegate.sources import register, resolve
from tidegate.types import SPARK, Schema


def by_key(df: DataFrame, key: str):
    """Numbers rows by the rank of their key. One range shuffle of the key; partition sizes are all that reaches the driver."""

    def number(rows: DataFrame) -> DataFrame:
        placed = df.select(q(key).alias(ORD)).repartitionByRange(q(ORD)).sortWithinPartitions(q(ORD))
        placed = cut(placed.withColumn("#part", F.spark_partition_id()).withColumn("#place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
        sizes = {r["#part"]: r["n"] for r in placed.groupBy("`#part`").agg(F.count(F.lit(1)).alias("n")).collect()}
        start, base = 0, []
        for part in sorted(sizes):
            base.append((part, start))
            start += sizes[part]
        bases = df.sparkSession.createDataFrame(base, "`#part` int, `#base` bigint")
        ranks = placed.join(F.broadcast(bases), "#part").select(q(ORD), (q("#base") + q("#place")).alias("#n"))  # one row per partition
        return rows.join(ranks, ORD)

    return number


def by_file(df: DataFrame):
    """Numbers rows by their file's first ordinal and their place in it; the sizes of files are in their footers."""

    def number(rows: DataFrame) -> DataFrame:
        sizes = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        first = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("#base"))  # one row per file
        return rows.join(first, q(ORD)["file"] == first["file"]).withColumn("#n", q("#base") + q(ORD)["row"]).drop("file", "#base")

    return number


def frame_of(df: DataFrame, schema: Schema, name: str, *, columns: dict[str, str] | None = None, order_by: str | None = None, files: bool = False) -> Frame:
    """A frame over a DataFrame, ordered by a unique column, by its ``files`` or not at all."""
    columns = columns or {}
    have = df.columns
    for n, t in schema.fields:
        if columns.get(n, n) not in have and not t.optional:
            raise BuildFault(f'table: required column "{columns.get(n, n)}" not found in {have}')
    number = None
    if order_by is not None:
        number = by_key(df, order_by)
        nullable = next((f.nullable for f in df.schema.fields if f.name == order_by), True)
        fault = F.raise_error(F.lit(f'order_by: column "{order_by}" holds a null')).cast(df.schema[order_by].dataType)
        df = df.withColumn(ORD, F.coalesce(q(order_by), fault) if nullable else q(order_by))
    elif files:
        number = by_file(df)
        df = df.withColumn(ORD, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    else:
        df = df.withColumn(ORD, F.lit(None).cast("bigint"))
    names, cols = {}, []
    for i, (n, t) in enumerate(schema.fields):
        from_ = columns.get(n, n)
        c = q(from_) if from_ in have else F.lit(None)
        if t.kind == "decimal" and from_ in have:
            d = df.schema[from_].dataType
            scale = d.scale if isinstance(d, T.DecimalType) else 0
            u = (c * F.lit(10**scale).cast("decimal(38,0)")).cast("decimal(38,0)")
            c = F.when(c.isNotNull(), F.struct(u.alias("u"), F.lit(scale).cast("int").alias("s")))
        elif from_ not in have or t.kind not in ("datetime",):
            c = c.cast(SPARK[t.kind])
        cols.append(c.alias(f"s{i}"))
        names[n] = f"s{i}"
    return Frame(df.select(q(ORD), F.lit(None).cast("bigint").alias(OFF), F.lit(None).cast(FAIL_TYPE).alias(FAIL), *cols), schema, names, name, dense=False, ordered=order_by is not None or files, fallible=False, number=number)


@register("parquet")
def parquet_source(spark: SparkSession, decl: SourceDecl, schema: Schema, base: str) -> Frame:
    key = decl.options.get("order_by")
    return frame_of(spark.read.parquet(resolve(base, decl.path)), schema, decl.name, columns=decl.columns, order_by=key and key.value, files=key is None)


@register("table")
def table_source(spark: SparkSession, decl: SourceDecl, schema: Schema, base: str) -> Frame:
    key = decl.options.get("order_by")
    return frame_of(spark.table(decl.path), schema, decl.name, columns=decl.columns, order_by=key and key.value)
