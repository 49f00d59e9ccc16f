"""A monthly panel with the raw schema, derived from order tables.

The tables at hand hold no surveys. Orders stand in for respondents: a nation's "uptake" in
a month is the running number of its finished orders of the season over all its orders of
the season.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasoncast.config import SeasonConfig
from seasoncast.functions.season import to_season

SEASON = SeasonConfig(start_month=7, start_day=1, end_month=4, end_day=1,
                      start_year=1996, end_year=2000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_panel(
    spark: SparkSession, sf_dir: str, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Raw panel over all orders; ``group_cols`` are order columns that split it into panels.

    Orders are counted per nation and month before anything else is joined, so only the
    customer join moves rows; the windows run over at most a season of months.
    """
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    keys = [*group_cols, "c_nationkey", "time_end"]
    monthly = (
        table(spark, sf_dir, "orders")
        .withColumn("time_end", month)
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        )
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("_season", to_season(F.col("time_end"), **SEASON.bounds))
    )
    whole = W.partitionBy(*group_cols, "_season", "n_name")
    running = F.sum("finished").over(whole.orderBy("time_end"))
    estimate = F.col("estimate")
    return monthly.withColumn("estimate", running / F.sum("n").over(whole)).select(
        *group_cols,
        F.when(F.col("n_name") == "NATION_24", "nation").otherwise("admin1").alias(
            "geography_type"
        ),
        F.col("n_name").alias("geography"),
        "time_end",
        "estimate",
        F.greatest(estimate - 0.05, F.lit(0.0)).alias("lci"),
        F.least(estimate + 0.05, F.lit(1.0)).alias("uci"),
        F.col("n").cast("int").alias("sample_size"),
    )
