"""Extraction, cleaning and the columns the models need."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasoncast.config import ForecastDates, SeasonConfig
from seasoncast.functions.season import month_in_season, season_geo, season_time, to_season
from seasoncast.schema import require_columns

# First-level areas that are left out.
EXCLUDED_GEOGRAPHIES = ("Puerto Rico", "U.S. Virgin Islands", "Guam")

# Interval suffixes of a date range and their SQL units.
_INTERVAL_UNITS = {
    "d": (1, "day"),
    "w": (1, "week"),
    "mo": (1, "month"),
    "q": (3, "month"),
    "y": (1, "year"),
}


def extract_slice(
    source: DataFrame,
    equals: Mapping[str, Any],
    members: Mapping[str, Sequence[Any]],
    columns: Sequence[str],
    order_by: Sequence[str],
) -> DataFrame:
    """Rows matching every condition, cut to ``columns`` and sorted for the sink."""
    for name, value in equals.items():
        source = source.filter(F.col(name) == F.lit(value))
    for name, values in members.items():
        source = source.filter(F.col(name).isin(list(values)))
    return source.select(*columns).orderBy(*order_by)


def preprocess(
    raw: DataFrame,
    season: SeasonConfig,
    geographies: Iterable[str] | None = None,
    date_col: str = "time_end",
    excluded: Sequence[str] = EXCLUDED_GEOGRAPHIES,
) -> DataFrame:
    """Keep first-level areas, the configured calendar years and in-season dates; add ``season``.

    One narrow pass: the geography and year filters reach the Parquet scan.
    """
    if season.start_year is None or season.end_year is None:
        raise ValueError("preprocess needs start_year and end_year")
    kept = raw.filter(
        (F.col("geography_type") == "admin1") & ~F.col("geography").isin(list(excluded))
    ).filter(
        # Calendar years as a range, which a Parquet scan can use to skip row groups.
        (F.col(date_col) >= F.lit(dt.date(season.start_year, 1, 1)))
        & (F.col(date_col) < F.lit(dt.date(season.end_year + 1, 1, 1)))
    )
    if geographies is not None:
        kept = kept.filter(F.col("geography").isin(list(geographies)))
    return (
        kept.withColumn("season", to_season(F.col(date_col), **season.bounds))
        .filter(F.col("season").isNotNull())
        .withColumnRenamed("sample_size", "N_tot")
    )


def date_range(start: Column, end: Column, interval: str = "1mo") -> Column:
    """Array of the dates from ``start`` to ``end``, both included."""
    count = interval.rstrip("abcdefghijklmnopqrstuvwxyz")
    unit = interval[len(count) :]
    if not count.isdigit() or unit not in _INTERVAL_UNITS:
        raise ValueError(f"unknown interval {interval!r}")
    number, name = _INTERVAL_UNITS[unit]
    return F.sequence(start, end, F.expr(f"interval {int(count) * number} {name}"))


def forecast_date_frame(spark: SparkSession, dates: ForecastDates) -> DataFrame:
    """Inclusive range of forecast dates."""
    days = date_range(F.lit(dates.start), F.lit(dates.end), dates.interval)
    return spark.range(1).select(F.explode(days).alias("forecast_date"))


def forecast_date_list(spark: SparkSession, dates: ForecastDates) -> list[dt.date]:
    """The same range as a list; its length is set by the configuration alone."""
    return [r[0] for r in forecast_date_frame(spark, dates).orderBy("forecast_date").collect()]


def training_snapshots(
    data: DataFrame, forecast_dates: Sequence[dt.date], date_col: str = "time_end"
) -> DataFrame:
    """One copy of each row per forecast date on or after it: every as-of view in one frame.

    The dates come from the configuration, so they travel inside the expression and no
    join or shuffle is needed.
    """
    dates = F.array(*[F.lit(d) for d in sorted(set(forecast_dates))])
    open_dates = F.filter(dates, lambda d: F.col(date_col) <= d)
    return data.withColumn("forecast_date", F.explode(open_dates))


def curve_columns(
    data: DataFrame, season: SeasonConfig, date_col: str = "time_end"
) -> DataFrame:
    """Add ``N_vax``, ``season_geo`` and ``t`` (years since the season start)."""
    require_columns(data, [date_col, "estimate", "season", "geography", "N_tot"])
    return data.withColumns(
        {
            "N_vax": F.bround(F.col("N_tot") * F.col("estimate"), 0),
            "season_geo": season_geo(F.col("season"), F.col("geography")),
            "t": season_time(F.col(date_col), season.start_month, season.start_day),
        }
    )


def month_column(data: DataFrame, season: SeasonConfig, date_col: str = "time_end") -> DataFrame:
    """Add ``t``, the month index within the season."""
    if season.start_day != 1:
        raise ValueError("month indices need a season that starts on the first of a month")
    return data.withColumn("t", month_in_season(F.col(date_col), season.start_month))


def date_crosswalk(
    data_t: DataFrame, date_col: str = "time_end", group_cols: Sequence[str] = ()
) -> DataFrame:
    """Distinct (season, date, month index) rows."""
    return data_t.select(*group_cols, "season", date_col, "t").distinct()
