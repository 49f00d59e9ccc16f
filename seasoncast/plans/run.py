"""A whole run: clean, fit, forecast, score, report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from seasoncast.config import RunConfig
from seasoncast.models import fit_all_models, predict_all_models
from seasoncast.operators.evaluate import score_forecast_season
from seasoncast.operators.prep import forecast_date_list, preprocess
from seasoncast.plans import report
from seasoncast.schema import require_rows
from seasoncast.sources import tables


class RunTables(NamedTuple):
    data: DataFrame
    predictions: DataFrame
    scores: DataFrame


def run(spark: SparkSession, config: RunConfig, raw: DataFrame, out_dir: str) -> RunTables:
    """Write ``data``, ``pred`` (by forecast date), ``scores`` and ``report`` under ``out_dir``.

    The report is made where the configuration names an example season.
    All forecast dates are fitted in one job per model. Written tables cut the lineage
    between the stages.
    """
    base = f"{out_dir}/{config.run_id}"
    clean = preprocess(raw, config.season, config.geographies)
    # Before anything is written: a run without data leaves earlier tables alone.
    require_rows(clean, "no data after preprocessing")
    tables.write_table(clean, f"{base}/data.parquet")
    data = tables.read_data(spark, f"{base}/data.parquet")

    dates = forecast_date_list(spark, config.forecast_dates)
    fitted = fit_all_models(
        data, dates, config.models, config.season, config.quantiles, config.group_cols
    )
    tables.write_predictions(predict_all_models(fitted, config.group_cols), f"{base}/pred")
    preds = tables.read_predictions(spark, f"{base}/pred")

    features = [*config.group_cols, "season", "geography"]
    scores = score_forecast_season(data, preds, config.season, features)
    tables.write_table(scores, f"{base}/scores.parquet")
    if config.example_season is not None:
        for name, table in report_tables(data, preds, config).items():
            tables.write_table(table, f"{base}/report/{name}.parquet")
    return RunTables(data, preds, tables.read_scores(spark, f"{base}/scores.parquet"))


def report_tables(data: DataFrame, preds: DataFrame, config: RunConfig) -> dict[str, DataFrame]:
    """The tables behind the charts of a run, by name.

    The labelled examples need five geographies at the last date and raise with fewer.
    """
    example = config.example_season
    panels = config.group_cols
    examples = report.trajectories(data, example, config.season)
    last = report.end_of_season(data, panels)
    cones = report.forecast_cones(preds, config.season, config.alpha, panels)
    seen = report.observations(data, example, panels)
    found = {
        "trajectories": examples,
        "end_of_season": last,
        "forecast_cones": cones,
        "forecast_vs_observed": report.forecast_against_observed(seen, cones, panels),
    }
    if not panels:
        # Labels and medians are of one panel.
        found |= {
            "labelled_examples": report.labelled_examples(examples),
            "season_medians": report.add_medians(last, "season"),
            "geography_medians": report.add_medians(last, "geography"),
            "geographies_by_median": report.geographies_by_median(last),
        }
    return found
