"""Rows at the last date of a group or of a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_at_last_date(
    df: DataFrame, by: Sequence[str], date_col: str = "time_end"
) -> DataFrame:
    """Rows whose date is the latest of their ``by`` group; ties stay, null dates never match.

    An aggregate and a semi join instead of a window: the maximum is combined before the
    shuffle, and the join key holds the date too, so that one large group spreads out.
    """
    names = {c: f"_last_{i}" for i, c in enumerate(by)}
    last = df.groupBy(*[F.col(c).alias(a) for c, a in names.items()]).agg(
        F.max(date_col).alias("_last_date")
    )
    on = F.col(date_col) == F.col("_last_date")
    for column, alias in names.items():
        on = on & F.col(column).eqNullSafe(F.col(alias))
    return df.join(last, on, "left_semi")


def rows_at_overall_last_date(df: DataFrame, date_col: str = "time_end") -> DataFrame:
    """Rows at the latest date of the whole table."""
    return df.filter(F.col(date_col) == df.agg(F.max(date_col)).scalar())
