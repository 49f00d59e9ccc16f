"""Declared table schemas and the run-time checks on them."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_STRING, _DATE, _DOUBLE, _INT = T.StringType(), T.DateType(), T.DoubleType(), T.IntegerType()

RAW = _struct(
    geography_type=_STRING,
    geography=_STRING,
    time_end=_DATE,
    estimate=_DOUBLE,
    lci=_DOUBLE,
    uci=_DOUBLE,
    sample_size=_INT,
)
DATA = _struct(
    geography_type=_STRING,
    geography=_STRING,
    time_end=_DATE,
    estimate=_DOUBLE,
    lci=_DOUBLE,
    uci=_DOUBLE,
    N_tot=_INT,
    season=_STRING,
)
PREDS = _struct(
    model=_STRING,
    forecast_date=_DATE,
    season=_STRING,
    geography=_STRING,
    quantile=_DOUBLE,
    time_end=_DATE,
    estimate=_DOUBLE,
)
SCORES = _struct(
    season=_STRING,
    geography=_STRING,
    model=_STRING,
    forecast_date=_DATE,
    score_fun=_STRING,
    score_value=_DOUBLE,
)


def require_columns(df: DataFrame, needed: Iterable[str]) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise AssertionError(f"missing columns: {missing}")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise RuntimeError(message)
    return df


def require_no_nulls(df: DataFrame) -> DataFrame:
    """Raise if any column of ``df`` holds a null."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    bad = {c: counts[c] for c in df.columns if counts[c]}
    if bad:
        raise AssertionError(f"nulls remain: {bad}")
    return df


def require_quantiles(preds: DataFrame, quantiles: Iterable[float]) -> None:
    """Every wanted quantile must occur; at most that many rows reach the driver."""
    wanted = sorted(set(quantiles))
    rows = preds.filter(F.col("quantile").isin(wanted)).select("quantile").distinct().collect()
    missing = sorted(set(wanted) - {r["quantile"] for r in rows})
    if missing:
        raise AssertionError(f"quantiles absent from the predictions: {missing}")


def single_value(df: DataFrame, column: str, message: str) -> Any:
    """The only distinct value of ``column``; null counts as a value."""
    values = [r[0] for r in df.select(column).distinct().limit(2).collect()]
    if len(values) != 1:
        raise AssertionError(message)
    return values[0]
