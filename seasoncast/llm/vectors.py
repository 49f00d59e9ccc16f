"""Vectors as rows: which take part, equal ones once, and packing them into blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_finite(vector: Column) -> Column:
    """Not null, not empty, every component a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``rep, vec, members`` from rows ``id, vec``: each vector once, with its ``keep`` smallest
    ids in order; ``rep`` is the smallest. A copied vector leaves each task at most ``keep`` times,
    since the limit on the rank is applied before the shuffle too.
    """
    own = Window.partitionBy("_key", "vec").orderBy("id")
    few = (
        rows.withColumn("_key", F.xxhash64("vec"))
        .withColumn("_n", F.row_number().over(own))
        .filter(F.col("_n") <= keep)
    )
    lists = few.groupBy("_key", "vec").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return lists.select(F.col("members")[0].alias("rep"), "vec", "members")


def blocks(rows: DataFrame, id_col: str, size: int, n_rows: int) -> tuple[DataFrame, int]:
    """``rows`` plus ``block``: about ``size`` rows each, dealt by a hash of the (unique) id."""
    many = max(1, -(-n_rows // size))
    return rows.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(many)).cast("int")), many


def stacked(column: pd.Series, dtype: type = np.float64) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=dtype) for v in column])
