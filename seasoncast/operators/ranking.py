"""Row numbers over a global order, and the selections built on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasoncast.sources.shared import cut_lineage

# monotonically_increasing_id keeps the partition number above this bit.
_PARTITION_BIT = 33


def _sorted_with_ids(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    return cut_lineage(
        df.orderBy(*order_by).withColumn("_row_id", F.monotonically_increasing_id())
    )


def _partition_offsets(ids: DataFrame) -> list[tuple[int, int, int]]:
    """(partition, rows before it, rows in it): one entry per sorted partition."""
    rows = (
        ids.groupBy(F.shiftright("_row_id", _PARTITION_BIT).alias("p"))
        .count()
        .orderBy("p")
        .collect()
    )
    out, before = [], 0
    for r in rows:
        out.append((r["p"], before, r["count"]))
        before += r["count"]
    return out


def with_row_index(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "row_index"
) -> DataFrame:
    """Zero-based position in the given order, without a single-task window.

    A range-partitioned sort gives each row its place within its partition; the offsets
    are one row per partition.
    """
    ids = _sorted_with_ids(df, order_by)
    offsets = df.sparkSession.createDataFrame(
        [(p, before) for p, before, _ in _partition_offsets(ids)], "_p bigint, _before bigint"
    )
    within = F.col("_row_id").bitwiseAND(F.lit((1 << _PARTITION_BIT) - 1))
    return (
        ids.withColumn("_p", F.shiftright("_row_id", _PARTITION_BIT))
        .join(F.broadcast(offsets), "_p")
        .withColumn(name, F.col("_before") + within)
        .drop("_p", "_before", "_row_id")
    )


def gather_n(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """``n`` evenly spaced rows of the ordered frame, the first and the last included."""
    if n <= 2:
        raise AssertionError("gather_n needs n > 2")
    ids = _sorted_with_ids(df, order_by)
    offsets = _partition_offsets(ids)
    height = sum(count for _, _, count in offsets)
    if height < n:
        raise AssertionError(f"asked for {n} rows, only have {height}")
    wanted = []
    for index in np.linspace(0, height - 1, num=n).round().astype(int).tolist():
        for p, before, count in offsets:
            if before <= index < before + count:
                wanted.append((p << _PARTITION_BIT) + index - before)
    return ids.filter(F.col("_row_id").isin(wanted)).drop("_row_id")


def best_and_worst(
    scores: DataFrame,
    month: str,
    n: int,
    value: str = "score_value",
    name_col: str = "geography",
) -> DataFrame:
    """The ``n`` lowest and ``n`` highest scores of a month; ties go by name.

    Two bounded top-n selections. Columns: ``kind``, ``position`` (ascending by score), name.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = scores.filter(F.col("month") == month).select(name_col, value)
    best = rows.orderBy(F.asc_nulls_first(value), F.asc(name_col)).limit(n)
    worst = rows.orderBy(F.desc_nulls_last(value), F.desc(name_col)).limit(n)

    def ranked(top: DataFrame, kind: str) -> DataFrame:
        ascending = F.array_sort(
            F.collect_list(F.struct(F.col(value).isNotNull().alias("k"), value, name_col))
        )
        return (
            top.agg(ascending.alias("rows"))
            .select(F.posexplode("rows").alias("position", "row"))
            .select(F.lit(kind).alias("kind"), "position", f"row.{name_col}")
        )

    return ranked(best, "best").unionByName(ranked(worst, "worst"))
