"""Scores of forecasts against the end of the season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.config import SeasonConfig
from seasoncast.functions.season import to_season
from seasoncast.operators.last_date import rows_at_last_date
from seasoncast.schema import single_value


def eos_abs_diff(
    obs: DataFrame,
    pred: DataFrame,
    features: Sequence[str],
    date_col: str = "time_end",
) -> DataFrame:
    """Absolute difference between the median forecast and the last observation of each group."""
    assert "season" in features, "features must include season"
    keys = [*features, date_col]
    last = rows_at_last_date(obs, features, date_col).select(
        *keys, F.col("estimate").alias("obs")
    )
    median = pred.filter(F.col("quantile") == F.lit(0.5)).select(
        *keys, "model", "forecast_date", F.col("estimate").alias("pred")
    )
    scores = last.join(median, keys, "inner").select(
        *features,
        "model",
        "forecast_date",
        F.lit("eos_abs_diff").alias("score_fun"),
        F.abs(F.col("pred") - F.col("obs")).alias("score_value"),
    )
    for column in scores.columns:
        scores = scores.filter(F.col(column).isNotNull())
    return scores


def forecast_season(pred: DataFrame, season: SeasonConfig) -> str | None:
    """The one season in which all forecasts were made."""
    label = pred.select(to_season(F.col("forecast_date"), **season.bounds).alias("season"))
    return single_value(label, "season", "forecasts must come from one season")


def score_forecast_season(
    data: DataFrame,
    pred: DataFrame,
    season: SeasonConfig,
    features: Sequence[str] = ("season", "geography"),
) -> DataFrame:
    """Score only the season in which the forecasts were made."""
    label = forecast_season(pred, season)
    in_season = F.col("season") == F.lit(label)
    return eos_abs_diff(data.filter(in_season), pred.filter(in_season), features)
