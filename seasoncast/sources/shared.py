"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a folder of the session's warehouse takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named is None and current is None:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    if current is None:
        spark.sparkContext.setCheckpointDir(named)
    return (named or current).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/seasoncast/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder.

    Lost executors then cost no recomputation, and plans of iterative work stay short: unlike
    a checkpoint, a file scan carries no constraints over from the plan that made it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
