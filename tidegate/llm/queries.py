"""Queries of the text and people problems over the driver's tables, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import dedupe, mixing, mojibake, names, pii, tokens


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.found(table(spark, d, "customer_export"), table(spark, d, "showcase"), table(spark, d, "nicknames"))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its entity."""
    return names.groups(names.people(table(spark, d, "customer_export"), table(spark, d, "showcase")), table(spark, d, "nicknames")).select("rec_id", "entity")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.copies(table(spark, d, "customer_export"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    return dedupe.groups(table(spark, d, "customer_export"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "customer_export"), table(spark, d, "etl_lines"), table(spark, d, "nicknames"))


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "customer_export"), table(spark, d, "etl_lines"), table(spark, d, "nicknames"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """How many times each page of a target source is used."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1].withColumn("actual_share", F.round("actual_share", 6))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p4_entities, p5_found, p5_groups, p7_found, p7_redacted, p8_ids, p9_mix, p9_shares, p10_found)}
