"""Run configuration: plain typed values, checked once on the driver."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

# Longest day that exists in every year, by month.
_MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


@dataclass(frozen=True)
class SeasonConfig:
    """Bounds of the over-winter season and of the calendar years kept."""

    start_month: int
    end_month: int
    start_day: int = 1
    end_day: int = 1
    start_year: int | None = None
    end_year: int | None = None

    def __post_init__(self) -> None:
        for month, day in ((self.start_month, self.start_day), (self.end_month, self.end_day)):
            if not 1 <= month <= 12 or not 1 <= day <= _MONTH_DAYS[month - 1]:
                raise ValueError(f"month {month} day {day} does not exist in every year")
        if (self.start_month, self.start_day) <= (self.end_month, self.end_day):
            raise AssertionError("only over-winter seasons are supported")

    @property
    def bounds(self) -> dict[str, int]:
        """Keyword arguments of :func:`seasoncast.functions.season.to_season`."""
        return {
            "season_start_month": self.start_month,
            "season_start_day": self.start_day,
            "season_end_month": self.end_month,
            "season_end_day": self.end_day,
        }


@dataclass(frozen=True)
class ForecastDates:
    start: dt.date
    end: dt.date
    interval: str = "1mo"


@dataclass(frozen=True)
class ModelConfig:
    name: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class RunConfig:
    run_id: str
    season: SeasonConfig
    models: tuple[ModelConfig, ...]
    alpha: float
    forecast_dates: ForecastDates
    geographies: tuple[str, ...] | None = None
    example_season: str | None = None
    group_cols: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> RunConfig:
        geographies = raw.get("geographies")
        return cls(
            run_id=raw["run_id"],
            season=SeasonConfig(**raw["season"]),
            models=tuple(ModelConfig(m["name"], dict(m.get("params") or {})) for m in raw["models"]),
            alpha=float(raw["alpha"]),
            forecast_dates=ForecastDates(**raw["forecast_dates"]),
            geographies=None if geographies is None else tuple(geographies),
            example_season=(raw.get("plots") or {}).get("example_season"),
            group_cols=tuple(raw.get("group_cols") or ()),
        )

    @property
    def quantiles(self) -> list[float]:
        return interval_quantiles(self.alpha)


def interval_quantiles(alpha: float) -> list[float]:
    """Median and the two ends of the central ``1 - alpha`` interval.

    Every stage takes its quantiles from here, so they compare equal as doubles.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return [0.5, alpha / 2, 1.0 - alpha / 2]
