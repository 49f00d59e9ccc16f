"""Parquet tables of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasoncast import schema


def read_raw(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """Raw panel with a declared schema; ``extra`` adds the panel key columns."""
    fields = list(schema.RAW.fields) + (list(extra.fields) if extra else [])
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """One partition folder per forecast date; a re-run replaces only its own dates.

    Rows of a date come together before the write, in files of even size: a task does not write
    one small file for every date.
    """
    (
        preds.hint("rebalance", "forecast_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("forecast_date")
        .parquet(path)
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions in canonical column order, extra panel keys first.

    A filter on ``forecast_date`` prunes whole folders.
    """
    df = spark.read.parquet(path).withColumn("forecast_date", F.col("forecast_date").cast("date"))
    canonical = schema.PREDS.fieldNames()
    keys = [c for c in df.columns if c not in canonical]
    return df.select(*keys, *canonical)
