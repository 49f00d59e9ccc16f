"""Forecasting models and their lookup by configured name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.config import ModelConfig, SeasonConfig
from seasoncast.models.base import CoverageModel
from seasoncast.models.curve import CurveModel
from seasoncast.models.forest import ForestModel

# The names a configuration uses.
MODELS: dict[str, Any] = {"LPLModel": CurveModel, "RFModel": ForestModel}

__all__ = [
    "MODELS",
    "CoverageModel",
    "CurveModel",
    "ForestModel",
    "fit_all_models",
    "predict_all_models",
    "register_model",
]


def register_model(name: str, model: type) -> None:
    """Make a user's model available under ``name``."""
    for method in ("fit", "predict"):
        if not callable(getattr(model, method, None)):
            raise AssertionError(f"{name} is not a valid model: no {method}()")
    MODELS[name] = model


def fit_all_models(
    data: DataFrame,
    forecast_dates: Sequence[dt.date],
    models: Sequence[ModelConfig],
    season: SeasonConfig,
    quantiles: Sequence[float],
    group_cols: Sequence[str] = (),
) -> dict[str, CoverageModel]:
    """Every configured model, fitted as of all forecast dates."""
    unknown = [m.name for m in models if m.name not in MODELS]
    if unknown:
        raise AssertionError(f"not valid models: {unknown}")
    return {
        m.name: MODELS[m.name](
            data=data,
            forecast_dates=forecast_dates,
            params=m.params,
            season=season,
            quantiles=quantiles,
            group_cols=group_cols,
        ).fit()
        for m in models
    }


def predict_all_models(
    models: dict[str, CoverageModel], group_cols: Sequence[str] = ()
) -> DataFrame:
    """Forecasts of all models in canonical column order."""
    columns = [
        *group_cols,
        "model",
        "forecast_date",
        "season",
        "geography",
        "quantile",
        "time_end",
        "estimate",
    ]
    parts = [m.predict().withColumn("model", F.lit(n)).select(*columns) for n, m in models.items()]
    return reduce(DataFrame.unionByName, parts)
