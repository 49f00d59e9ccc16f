import datetime as dt

import pytest
from pyspark.sql import functions as F

from seasoncast.config import ForecastDates, RunConfig, SeasonConfig, interval_quantiles
from seasoncast.functions.season import (
    days_in_season,
    month_in_season,
    month_order,
    season_geo,
    to_season,
)
from seasoncast.operators.prep import forecast_date_list


def labels(spark, dates, **bounds):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, d date")
    rows = df.select("i", to_season(F.col("d"), **bounds).alias("s")).orderBy("i").collect()
    return [r["s"] for r in rows]


BOUNDS = {"season_start_month": 7, "season_end_month": 4}


def test_before_after_and_between(spark):
    dates = [dt.date(2020, 1, 1), dt.date(2020, 11, 1), dt.date(2020, 6, 1)]
    assert labels(spark, dates, **BOUNDS) == ["2019/2020", "2020/2021", None]


def test_only_over_winter(spark):
    with pytest.raises(AssertionError):
        to_season(F.col("d"), season_start_month=4, season_end_month=7)
    with pytest.raises(AssertionError):
        SeasonConfig(4, 7)


def test_both_ends_belong(spark):
    dates = [
        dt.date(2020, 4, 1), dt.date(2020, 4, 2), dt.date(2020, 6, 30), dt.date(2020, 7, 1),
        dt.date(2020, 12, 31), dt.date(2021, 1, 1), dt.date(2020, 2, 29), None,
    ]
    want = ["2019/2020", None, None, "2020/2021", "2020/2021", "2020/2021", "2019/2020", None]
    assert labels(spark, dates, **BOUNDS) == want


def test_late_on_the_end_day_still_belongs(spark):
    late = spark.sql("SELECT timestamp'2020-04-01 18:00:00' AS d")
    assert late.select(to_season(F.col("d"), **BOUNDS)).first()[0] == "2019/2020"


def test_days_and_months(spark):
    df = spark.sql("SELECT explode(sequence(date'2019-01-01', date'2021-12-31')) AS d")
    span = df.select(days_in_season(F.col("d"), 7).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert tuple(span) == (0, 365)
    firsts = df.filter(F.dayofmonth("d") == 1).select("d", month_in_season(F.col("d"), 7).alias("t"))
    assert {(r.d.month, r.t) for r in firsts.collect()} == {(m, (m - 7) % 12) for m in range(1, 13)}


def test_month_index_needs_the_first_of_a_month(spark):
    df = spark.sql("SELECT date'2020-01-15' AS d")
    with pytest.raises(Exception, match="not the first of a month"):
        df.select(month_in_season(F.col("d"), 7)).collect()


def test_month_order():
    assert month_order(7) == "Jul Aug Sep Oct Nov Dec Jan Feb Mar Apr May Jun".split()


def test_season_geo_is_null_with_a_null_part(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "s string, g string")
    got = [r[0] for r in df.select(season_geo(F.col("s"), F.col("g"))).collect()]
    assert got == ["a_b", None]


def test_config(spark):
    with pytest.raises(ValueError):
        SeasonConfig(7, 2, end_day=29)
    assert interval_quantiles(0.05) == [0.5, 0.025, 0.975]
    dates = forecast_date_list(spark, ForecastDates(dt.date(2021, 7, 1), dt.date(2022, 4, 1)))
    assert len(dates) == 10 and dates[-1] == dt.date(2022, 4, 1)
    config = RunConfig.from_dict(
        {
            "run_id": "r",
            "season": {"start_month": 7, "end_month": 4},
            "geographies": None,
            "models": [{"name": "RFModel", "params": {"n_estimators": 3}}],
            "alpha": 0.1,
            "forecast_dates": {"start": dt.date(2021, 7, 1), "end": dt.date(2021, 8, 1)},
        }
    )
    assert config.geographies is None and config.models[0].params == {"n_estimators": 3}
