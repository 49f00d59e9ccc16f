"""Linear-interpolated quantiles of an array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interpolated(sorted_values: Column, q: float) -> Column:
    """Quantile ``q`` of an ascending array, linear between order statistics."""
    position = (F.size(sorted_values) - 1) * F.lit(float(q))
    low = F.floor(position).cast("int")
    at_low = F.get(sorted_values, low)
    at_high = F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return at_low + (at_high - at_low) * (position - low)
