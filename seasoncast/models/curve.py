"""The hierarchical logistic-plus-line model."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from typing_extensions import Self

from seasoncast.config import SeasonConfig
from seasoncast.functions.curve import lpl_curve
from seasoncast.models.curve_fit import PRIOR_NAMES, fit_curves, training_rows
from seasoncast.models.curve_predict import (
    effect_summary,
    posterior_draws,
    posterior_summary,
    predict_curves,
)
from seasoncast.models.curve_scales import effective_points, scale_design
from seasoncast.models.curve_weights import CHECKED, draw_weights, weight_summary
from seasoncast.operators.prep import curve_columns
from seasoncast.schema import require_columns


#: Stands for a null geography, which is a geography like others, while keys are joined.
_NO_NAME = "\u0000"


def _renamed(frame: DataFrame) -> DataFrame:
    return frame.withColumn("geography", F.nullif(F.col("geography"), F.lit(_NO_NAME)))


class CurveModel:
    """Logistic-plus-line curves with effects of season, geography and their pairs.

    The posterior is a mixture: for each of a few points of the effect scales, weighted by their
    evidence, a normal distribution of the other parameters on log and logit scales. The
    concentration is drawn on its own, as the curve does not depend on it.
    """

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
    ) -> None:
        require_columns(data, [date_column, "estimate", "season", "geography", "N_tot", *group_cols])
        missing = sorted(set(PRIOR_NAMES) - set(params))
        if missing:
            raise ValueError(f"missing prior parameters: {missing}")
        self.forecast_dates = list(forecast_dates)
        self.prior = {name: float(params[name]) for name in PRIOR_NAMES}
        self.n_draws = int(params.get("num_samples", 500)) * int(params.get("num_chains", 4))
        self.seed = int(params.get("seed", 0))
        self.quantiles = list(quantiles)
        self.group_cols = list(group_cols)
        self.date_column = date_column
        self.rows = curve_columns(data, season, date_column).withColumn(
            "geography", F.coalesce("geography", F.lit(_NO_NAME))
        )
        self.fits: DataFrame | None = None
        self.groups: DataFrame | None = None
        self.design: DataFrame | None = None
        self._seasons: list[str] | None = None

    @property
    def seasons(self) -> list[str]:
        """All season labels in order: as many as years in the data."""
        if self._seasons is None:
            found = self.rows.select("season").filter("season IS NOT NULL").distinct()
            self._seasons = sorted(r[0] for r in found.collect())
        return self._seasons

    def fit(self) -> Self:
        self.fits, self.groups = fit_curves(
            self.rows,
            self.forecast_dates,
            self.seasons,
            self.prior,
            self.group_cols,
            self.date_column,
        )
        self.design = scale_design(
            self.fits, self.groups, [*self.group_cols, "forecast_date"], self.prior, self.seed
        )
        return self

    def _fitted(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        if self.fits is None or self.groups is None or self.design is None:
            raise AssertionError("fit the model first")
        return self.fits, self.groups, self.design

    def predict(self) -> DataFrame:
        """Forecasts for all dates in the data, those before the forecast date included."""
        fits, groups, design = self._fitted()
        return _renamed(
            predict_curves(
                self.rows,
                fits,
                groups,
                design,
                self.seasons,
                self.quantiles,
                self.n_draws,
                self.seed,
                self.group_cols,
                self.date_column,
            )
        )

    def draws(self) -> DataFrame:
        """Draws of the shared parameters, the scales and D."""
        fits, _, design = self._fitted()
        return posterior_draws(fits, design, self.n_draws, self.seed, self.group_cols)

    def weights(self, n_draws: int = CHECKED) -> DataFrame:
        """Log importance weights of ``n_draws`` draws of each fit, from all its training rows."""
        fits, groups, design = self._fitted()
        keys = [*self.group_cols, "forecast_date"]
        obs = training_rows(
            self.rows, self.forecast_dates, self.seasons, keys, self.date_column
        )
        return draw_weights(
            obs, fits, groups, design, self.prior, self.seed, self.group_cols, n_draws
        )

    def summary(self) -> DataFrame:
        """Mean, spread and quantiles of the shared parameters, the six scales and D.

        Columns of the fit go with each: how many equally weighted points the design of scales is
        worth, how many of ``CHECKED`` draws the weighted ones are worth, and their tail index;
        above 0.7 the normal approximation does not hold there.
        """
        own = posterior_summary(self.draws(), self.group_cols)
        keys = [*self.group_cols, "forecast_date"]
        checked = weight_summary(self.weights(), self.group_cols)
        return own.join(effective_points(self._fitted()[2], keys), keys).join(
            checked.select(*keys, "effective_draws", "tail_index"), keys
        )

    def effects(self) -> DataFrame:
        """Mean, spread and quantiles of all effects of seasons, geographies and their pairs."""
        _, groups, design = self._fitted()
        return _renamed(
            effect_summary(
                groups, design, self.seasons, self.n_draws, self.seed, self.group_cols
            )
        )

    def save(self, path: str) -> None:
        fits, groups, design = self._fitted()
        design.write.mode("overwrite").parquet(f"{path}/design")
        fits.write.mode("overwrite").parquet(f"{path}/fits")
        groups.write.mode("overwrite").parquet(f"{path}/groups")
        labels = [(i, s) for i, s in enumerate(self.seasons)]
        spark = fits.sparkSession
        spark.createDataFrame(labels, "s int, season string").write.mode("overwrite").parquet(
            f"{path}/seasons"
        )

    def load(self, spark: SparkSession, path: str) -> Self:
        self.fits = spark.read.parquet(f"{path}/fits")
        self.groups = spark.read.parquet(f"{path}/groups")
        self.design = spark.read.parquet(f"{path}/design")
        self._seasons = [r[0] for r in spark.read.parquet(f"{path}/seasons").orderBy("s").select("season").collect()]
        return self


def group_parameter(mu: Column, *effects: Column) -> Column:
    """Grand mean plus effects: the height or slope of a group."""
    for effect in effects:
        mu = mu + effect
    return mu


def trajectory(
    rows: DataFrame,
    effects: DataFrame,
    muA: Column,
    muM: Column,
    K: Column,
    tau: Column,
    effect_index: str = "per_feature",
) -> DataFrame:
    """Add ``v``, the latent curve of every row, for given effects.

    ``rows`` carry ``t`` and the codes ``season_code``, ``geography_code``,
    ``season_geo_code``; ``effects`` (feature, code, effect_A, effect_M). With
    ``effect_index="shared"`` all features look their code up in one list, ``feature`` being
    ignored, so that equal codes share an effect.
    """
    if effect_index not in ("per_feature", "shared"):
        raise ValueError(f"unknown effect_index {effect_index!r}")
    for feature in ("season", "geography", "season_geo"):
        own = effects
        if effect_index == "per_feature":
            own = effects.filter(F.col("feature") == feature)
        own = own.select(
            F.col("code").alias(f"{feature}_code"),
            F.col("effect_A").alias(f"_A_{feature}"),
            F.col("effect_M").alias(f"_M_{feature}"),
        )
        rows = rows.join(own, f"{feature}_code", "left")
    features = ("season", "geography", "season_geo")
    A = group_parameter(muA, *[F.col(f"_A_{f}") for f in features])
    M = group_parameter(muM, *[F.col(f"_M_{f}") for f in features])
    made = [f"_{p}_{f}" for p in "AM" for f in features]
    return rows.withColumn("v", lpl_curve(A, M, K, tau, F.col("t"))).drop(*made)
