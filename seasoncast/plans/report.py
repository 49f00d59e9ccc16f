"""The tables behind the usual charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.config import SeasonConfig, interval_quantiles
from seasoncast.functions.season import month_label, month_rank
from seasoncast.operators.evaluate import forecast_season
from seasoncast.operators.last_date import rows_at_last_date, rows_at_overall_last_date
from seasoncast.operators.medians import group_median
from seasoncast.operators.ranking import gather_n
from seasoncast.schema import require_quantiles


def trajectories(data: DataFrame, season_label: str, season: SeasonConfig) -> DataFrame:
    """One season's rows with a month label and its place in the season."""
    return data.filter(F.col("season") == F.lit(season_label)).withColumns(
        {
            "month": month_label(F.col("time_end")),
            "month_rank": month_rank(F.col("time_end"), season.start_month),
        }
    )


def labelled_examples(trajectory_rows: DataFrame, n: int = 5) -> DataFrame:
    """``n`` evenly spaced rows, by estimate, among those at the last date."""
    last = rows_at_overall_last_date(trajectory_rows)
    return gather_n(last, n, ["estimate", "geography"])


def end_of_season(data: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Rows at each season's last date over all geographies."""
    return rows_at_last_date(data, [*group_cols, "season"])


def add_medians(
    df: DataFrame, group_by: str, value_col: str = "estimate", type_col: str = "type"
) -> DataFrame:
    """The rows themselves (``datum``) and one ``median`` row per group."""
    data = df.select(group_by, value_col, F.lit("datum").alias(type_col))
    medians = group_median(df, group_by, value_col).withColumn(type_col, F.lit("median"))
    return data.unionByName(medians)


def geographies_by_median(eos: DataFrame, value_col: str = "estimate") -> DataFrame:
    """Geographies by descending median: the axis order."""
    return group_median(eos, "geography", value_col).orderBy(F.desc(value_col), "geography")


def forecast_cones(
    preds: DataFrame, season: SeasonConfig, alpha: float, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Later dates of the forecast season, one column per quantile of the interval.

    The quantile columns come from one conditional aggregate, not from a join per quantile.
    """
    median, low, high = interval_quantiles(alpha)
    names = {low: "pred_lci", median: "pred_estimate", high: "pred_uci"}
    require_quantiles(preds, names)
    label = forecast_season(preds, season)
    wanted = preds.filter(
        (F.col("time_end") > F.col("forecast_date"))
        & (F.col("season") == F.lit(label))
        & F.col("quantile").isin(list(names))
    )
    return wanted.groupBy(*group_cols, "model", "forecast_date", "geography", "time_end").agg(
        *[
            F.max(F.when(F.col("quantile") == q, F.col("estimate"))).alias(name)
            for q, name in names.items()
        ]
    )


def quantile_names(quantile, alpha: float):
    """Column name of a quantile as an expression; any other value raises."""
    median, low, high = interval_quantiles(alpha)
    return (
        F.when(quantile == low, "pred_lci")
        .when(quantile == median, "pred_estimate")
        .when(quantile == high, "pred_uci")
        .otherwise(F.raise_error(F.concat(F.lit("unmapped quantile "), quantile.cast("string"))))
    )


def observations(data: DataFrame, season_label: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Observations of one season with the interval columns renamed."""
    return data.filter(F.col("season") == F.lit(season_label)).select(
        *group_cols,
        "geography",
        "time_end",
        F.col("estimate").alias("obs_estimate"),
        F.col("lci").alias("obs_lci"),
        F.col("uci").alias("obs_uci"),
    )


def usable_forecasts(cones: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """(model, forecast date) pairs with estimates on at least two dates; null counts as a date."""
    dates = F.count_distinct("time_end") + F.max(F.col("time_end").isNull().cast("int"))
    return (
        cones.filter(F.col("pred_estimate").isNotNull())
        .groupBy(*group_cols, "model", "forecast_date")
        .agg(dates.alias("n"))
        .filter(F.col("n") >= 2)
        .select(*group_cols, "model", "forecast_date")
    )


def forecast_against_observed(
    obs: DataFrame, cones: DataFrame, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Every observation beside every usable forecast, with the forecast's cone where it has one.

    The usable forecasts are a few pairs set by the configuration (models times dates), so
    they reach the observations as an array instead of through a Cartesian join.
    """
    pairs = usable_forecasts(cones, group_cols)
    pair_list = F.collect_list(F.struct("model", "forecast_date"))
    if group_cols:
        per_panel = pairs.groupBy(*group_cols).agg(pair_list.alias("_pairs"))
        beside = obs.join(per_panel, list(group_cols))
    else:
        beside = obs.withColumn("_pairs", pairs.agg(pair_list).scalar())
    rows = beside.withColumn("_pair", F.explode("_pairs")).select(
        *obs.columns, "_pair.model", "_pair.forecast_date"
    )
    keys = [*group_cols, "model", "geography", "forecast_date", "time_end"]
    columns = [*group_cols, "geography", "time_end", "obs_estimate", "obs_lci", "obs_uci",
               "model", "forecast_date", "pred_lci", "pred_estimate", "pred_uci"]
    return rows.join(cones, keys, "left").select(*columns)


def scores_of(scores: DataFrame, score_fun: str = "eos_abs_diff") -> DataFrame:
    return scores.filter(F.col("score_fun") == F.lit(score_fun))
