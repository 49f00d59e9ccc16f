"""Month columns out of rows and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDEX = ("season", "geography")


def months_present(data_t: DataFrame) -> list[int]:
    """Month indices that occur: at most twelve values."""
    return sorted(r[0] for r in data_t.select("t").distinct().collect() if r[0] is not None)


def pivot_months(
    data_t: DataFrame,
    months: Sequence[int],
    value: str = "estimate",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """One row per (season, geography), one column per known month; a second row for a cell raises.

    One aggregate with conditional columns, combined before the shuffle.
    """

    def cell(month: int):
        here = F.col("t") == month
        return F.when(
            F.count_if(here) > 1, F.raise_error(F.lit(f"two rows for month {month}")).cast("double")
        ).otherwise(F.max(F.when(here, F.col(value))))

    return data_t.groupBy(*group_cols, *INDEX).agg(*[cell(m).alias(str(m)) for m in months])


def unpivot_months(
    wide: DataFrame,
    months: Sequence[int],
    value: str = "estimate",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Long form of month columns, ``t`` as a number."""
    return wide.unpivot(
        [*group_cols, *INDEX], [str(m) for m in months], "t", value
    ).withColumn("t", F.col("t").cast("long"))
