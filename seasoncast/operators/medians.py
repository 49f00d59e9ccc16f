"""Exact medians per group that hold when one group has most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasoncast.sources.shared import cut_lineage

# monotonically_increasing_id keeps the partition number above this bit.
_PARTITION_BIT = 33


def group_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row per group with its exact median (null when the group has only nulls).

    One way for all sizes: equal values become one row with a weight, before the shuffle; a sort
    by group and value cuts even a group with most of the rows over many tasks; sums of weights,
    one number per group and sorted partition, give each value its ranks. Values are in Spark's
    order, NaN last, as in the built-in aggregate; infinities are values like others.
    """
    weighted = (
        df.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v"))
        .agg(F.count(value).alias("_w"))
        .orderBy("_g", "_v")
        .withColumn("_part", F.shiftright(F.monotonically_increasing_id(), _PARTITION_BIT))
    )
    kept = cut_lineage(weighted)
    parts = kept.groupBy("_g", "_part").agg(F.sum("_w").alias("_in_part"))
    # One row per sorted partition that a group reaches.
    by_group = W.partitionBy("_g")
    in_order = by_group.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = parts.select(
        "_g",
        "_part",
        (F.sum("_in_part").over(in_order) - F.col("_in_part")).alias("_before"),
        F.sum("_in_part").over(by_group).alias("_n"),
    )
    within = W.partitionBy("_g", "_part").orderBy("_v")
    upto = F.sum("_w").over(within.rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = (
        _null_safe_join(kept.withColumn("_upto", upto), offsets, "_g", "_part")
        .withColumn("_upto", F.col("_before") + F.col("_upto"))
        .withColumn("_from", F.col("_upto") - F.col("_w"))
    )

    def holds(rank: Column) -> Column:
        return (F.col("_from") <= rank) & (rank < F.col("_upto"))

    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = ranked.groupBy("_g").agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_low"),
        F.max(F.when(holds(high), F.col("_v"))).alias("_high"),
    )
    median = F.when(F.col("_low") == F.col("_high"), F.col("_low").cast("double")).otherwise(
        F.col("_low") * 0.5 + F.col("_high") * 0.5
    )
    return middle.select(F.col("_g").alias(group), median.alias(value))


def _null_safe_join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    conditions: list[Column] = [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys]
    on = reduce(lambda a, b: a & b, conditions)
    return left.join(renamed, on).drop(*[f"{k}__r" for k in keys])
