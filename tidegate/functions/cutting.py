"""Cutting lineage on storage that outlives an executor."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidegate.nodes import BuildFault


def folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; without one nothing is cut, for a folder of one machine's disk is none on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise BuildFault("spark.checkpoint.dir is not set: it must name a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read again.

    Unlike a checkpoint the result has the size of its files, where a checkpoint keeps the estimate of the plan before it;
    over many rounds of joins such estimates multiply."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
