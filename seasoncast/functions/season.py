"""Season arithmetic on date columns.

Everything works on ``month * 100 + day`` and year numbers, so no date that may not
exist (29 February) is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _month_day(date: Column) -> Column:
    return F.month(date) * 100 + F.dayofmonth(date)


def _start_year(date: Column, start_month: int, start_day: int) -> Column:
    """Year of the latest season start on or before ``date``."""
    year = F.year(date)
    return F.when(_month_day(date) < start_month * 100 + start_day, year - 1).otherwise(year)


def to_season(
    date: Column,
    season_start_month: int,
    season_end_month: int,
    season_start_day: int = 1,
    season_end_day: int = 1,
) -> Column:
    """Label such as ``2020/2021``; null between two seasons. Both ends belong to the season."""
    start = season_start_month * 100 + season_start_day
    end = season_end_month * 100 + season_end_day
    assert start > end, "only over-winter seasons are supported"
    day = F.to_date(date)
    first = F.when(_month_day(day) <= end, F.year(day) - 1).when(
        _month_day(day) >= start, F.year(day)
    )
    return F.when(first.isNotNull(), F.format_string("%d/%d", first, first + 1))


def days_in_season(date: Column, season_start_month: int, season_start_day: int = 1) -> Column:
    """Days since the latest season start."""
    day = F.to_date(date)
    year = _start_year(day, season_start_month, season_start_day)
    return F.datediff(day, F.make_date(year, F.lit(season_start_month), F.lit(season_start_day)))


def season_time(date: Column, season_start_month: int, season_start_day: int = 1) -> Column:
    """Time since the season start in years of 365 days."""
    return days_in_season(date, season_start_month, season_start_day) / F.lit(365.0)


def month_in_season(date: Column, season_start_month: int, season_start_day: int = 1) -> Column:
    """Months since the season start; raises unless ``date`` is the first of a month."""
    day = F.to_date(date)
    year = _start_year(day, season_start_month, season_start_day)
    months = (F.year(day) - year) * 12 + F.month(day) - season_start_month
    return F.when(
        F.dayofmonth(day) != 1,
        F.raise_error(F.concat(F.lit("not the first of a month: "), day.cast("string"))).cast("int"),
    ).otherwise(months)


def month_label(date: Column) -> Column:
    """English month abbreviation."""
    return F.date_format(date, "MMM")


def month_rank(date: Column, season_start_month: int) -> Column:
    """Sort key that puts months in season order."""
    return F.pmod(F.month(date) - season_start_month, F.lit(12))


def month_order(season_start_month: int) -> list[str]:
    """The twelve month abbreviations in season order."""
    names = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    first = season_start_month - 1
    return names[first:] + names[:first]


def season_geo(season: Column, geography: Column) -> Column:
    """Key of a season-geography pair; null if either part is null."""
    return F.concat(season, F.lit("_"), geography)
