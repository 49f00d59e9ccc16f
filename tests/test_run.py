import datetime as dt

import pytest
from pyspark.sql import functions as F

from seasoncast.config import RunConfig
from seasoncast.models import MODELS, register_model
from seasoncast.plans.run import run
from seasoncast.sources import tables


class Persistence:
    """A user's model: every forecast repeats the estimate."""

    def __init__(self, *, data, forecast_dates, params, season, quantiles, group_cols=(), date_column="time_end"):
        self.data, self.dates, self.quantiles = data, forecast_dates, quantiles

    def fit(self):
        return self

    def predict(self):
        return (
            self.data.select("season", "geography", "time_end", "estimate")
            .withColumn("forecast_date", F.explode(F.array(*[F.lit(d) for d in self.dates])))
            .withColumn("quantile", F.explode(F.array(*[F.lit(q) for q in self.quantiles])))
        )


def config(start, end, out="r", example=None):
    return RunConfig.from_dict(
        {
            "run_id": out,
            "season": {"start_month": 7, "end_month": 4, "start_year": 2018, "end_year": 2020},
            "models": [{"name": "Persistence"}],
            "alpha": 0.1,
            "forecast_dates": {"start": start, "end": end},
            "plots": {"example_season": example},
        }
    )


def test_run_writes_data_predictions_and_scores(spark, tmp_path):
    register_model("Persistence", Persistence)
    try:
        raw = spark.createDataFrame(
            [("admin1", g, dt.date(2019, m, 1), m / 100, 0.0, 1.0, 10) for g in "ab" for m in range(7, 13)],
            "geography_type string, geography string, time_end date, estimate double, "
            "lci double, uci double, sample_size int",
        )
        out = run(spark, config(dt.date(2019, 10, 1), dt.date(2019, 12, 1)), raw, str(tmp_path))
        assert out.data.count() == 12 and out.predictions.count() == 12 * 3 * 3
        assert out.predictions.columns == [
            "model", "forecast_date", "season", "geography", "quantile", "time_end", "estimate"
        ]
        assert {r.score_value for r in out.scores.collect()} == {0.0} and out.scores.count() == 6
        folders = sorted(p.name for p in (tmp_path / "r" / "pred").glob("forecast_date=*"))
        assert folders == [f"forecast_date=2019-{m}-01" for m in (10, 11, 12)]

        # A second run over one date leaves the other dates alone.
        run(spark, config(dt.date(2019, 12, 1), dt.date(2019, 12, 1)), raw, str(tmp_path))
        assert tables.read_predictions(spark, str(tmp_path / "r" / "pred")).count() == 12 * 3 * 3

        # A run without data stops before it writes.
        try:
            run(spark, config(dt.date(2019, 12, 1), dt.date(2019, 12, 1)), raw.limit(0), str(tmp_path))
        except RuntimeError as error:
            assert "no data" in str(error)
        else:
            raise AssertionError("an empty run went through")
        assert tables.read_data(spark, str(tmp_path / "r" / "data.parquet")).count() == 12
    finally:
        MODELS.pop("Persistence")


def test_report_tables_of_a_run(spark, tmp_path):
    register_model("Persistence", Persistence)
    try:
        raw = spark.createDataFrame(
            [("admin1", g, dt.date(2019, m, 1), m / 100 + i / 1000, 0.0, 1.0, 10)
             for i, g in enumerate("abcde") for m in range(7, 13)],
            "geography_type string, geography string, time_end date, estimate double, "
            "lci double, uci double, sample_size int",
        )
        dates = dt.date(2019, 10, 1), dt.date(2019, 12, 1)
        run(spark, config(*dates, example="2019/2020"), raw, str(tmp_path))
        folder = tmp_path / "r" / "report"
        sizes = {p.stem: spark.read.parquet(str(p)).count() for p in folder.iterdir()}
        # October sees two later months and November one, so only October's forecast is usable.
        assert sizes == {
            "trajectories": 30, "end_of_season": 5, "forecast_cones": 15, "forecast_vs_observed": 30,
            "labelled_examples": 5, "season_medians": 6, "geography_medians": 10, "geographies_by_median": 5,
        }
        order = [r.geography for r in spark.read.parquet(str(folder / "geographies_by_median.parquet")).collect()]
        assert sorted(order) == list("abcde")
    finally:
        MODELS.pop("Persistence")
