"""What every forecasting model offers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame
from typing_extensions import Self

from seasoncast.config import SeasonConfig


class CoverageModel(Protocol):
    """A model of all panels in ``data``, fitted as of each forecast date."""

    def __init__(
        self,
        *,
        data: DataFrame,
        forecast_dates: Sequence[dt.date],
        params: dict[str, Any],
        season: SeasonConfig,
        quantiles: Sequence[float],
        group_cols: Sequence[str] = (),
        date_column: str = "time_end",
    ) -> None: ...

    def fit(self) -> Self:
        """Fit on the rows known at each forecast date."""
        ...

    def predict(self) -> DataFrame:
        """Long forecasts: panel keys, forecast date, season, geography, quantile, date, estimate."""
        ...
