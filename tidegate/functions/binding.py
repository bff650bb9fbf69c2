"""Binding a computed value to a column once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``value`` as column ``name`` so that later uses read it instead of repeating its expression.

    The optimizer merges projections and would copy a shared expression into each use, which grows
    exponentially over several steps.  A one-element ``explode`` is a generator, which projections are
    not merged across, and it stays inside code generation.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
