"""Seasonal-uptake forecasting on Spark DataFrames."""

from seasoncast.config import RunConfig, SeasonConfig, interval_quantiles
from seasoncast.functions.season import days_in_season, month_in_season, to_season
from seasoncast.models import CurveModel, ForestModel, fit_all_models, predict_all_models
from seasoncast.operators.evaluate import eos_abs_diff, score_forecast_season
from seasoncast.operators.prep import preprocess

__all__ = [
    "CurveModel",
    "ForestModel",
    "RunConfig",
    "SeasonConfig",
    "days_in_season",
    "eos_abs_diff",
    "fit_all_models",
    "interval_quantiles",
    "month_in_season",
    "predict_all_models",
    "preprocess",
    "score_forecast_season",
    "to_season",
]
