import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from seasoncast.config import SeasonConfig
from seasoncast.operators import encode, medians, prep, ranking, reshape
from seasoncast.operators.evaluate import eos_abs_diff, forecast_season
from seasoncast.operators.last_date import rows_at_last_date
from seasoncast.plans import report
from seasoncast.schema import require_no_nulls, require_quantiles, require_rows

D = dt.date
SEASON = SeasonConfig(7, 4, start_year=2018, end_year=2019)


def raw(spark, rows):
    return spark.createDataFrame(
        [(k, g, d, 0.5, 0.4, 0.6, 100) for k, g, d in rows],
        "geography_type string, geography string, time_end date, estimate double, "
        "lci double, uci double, sample_size int",
    )


def test_preprocess_years_and_geographies(spark):
    rows = [
        ("admin1", "A", D(2018, 1, 1)),
        ("admin1", "A", D(2018, 7, 1)),
        ("admin1", "A", D(2020, 1, 1)),
        ("admin1", "A", D(2019, 6, 1)),
        ("admin1", "B", D(2019, 7, 1)),
        ("admin1", None, D(2019, 7, 1)),
        ("nation", "A", D(2019, 7, 1)),
        *[("admin1", g, D(2019, 7, 1)) for g in ("Puerto Rico", "U.S. Virgin Islands", "Guam")],
    ]
    out = prep.preprocess(raw(spark, rows), SEASON)
    got = {(r.geography, r.time_end, r.season) for r in out.collect()}
    assert got == {
        ("A", D(2018, 1, 1), "2017/2018"),
        ("A", D(2018, 7, 1), "2018/2019"),
        ("B", D(2019, 7, 1), "2019/2020"),
    }
    assert "N_tot" in out.columns and "sample_size" not in out.columns
    assert prep.preprocess(raw(spark, rows), SEASON, geographies=["B"]).count() == 1
    with pytest.raises(RuntimeError):
        require_rows(prep.preprocess(raw(spark, rows), SEASON, geographies=["Z"]), "nothing")


OBS = "season string, geography string, time_end date, estimate double"
PRED = OBS + ", model string, forecast_date date, quantile double"


def test_last_rows_ties_nulls_and_uneven_groups(spark):
    rows = [
        ("s", "a", D(2020, 3, 1), 1.0),
        ("s", "a", D(2020, 4, 1), 2.0),
        ("s", "a", D(2020, 4, 1), 3.0),
        ("s", "b", D(2020, 3, 1), 4.0),
        ("s", "b", None, 5.0),
        (None, "c", D(2020, 1, 1), 6.0),
        ("t", "d", None, 7.0),
    ]
    df = spark.createDataFrame(rows, OBS)
    by_both = {r.estimate for r in rows_at_last_date(df, ["season", "geography"]).collect()}
    by_season = {r.estimate for r in rows_at_last_date(df, ["season"]).collect()}
    assert by_both == {2.0, 3.0, 4.0, 6.0}
    assert by_season == {2.0, 3.0, 6.0}


def test_scores_drop_nulls_and_keep_nan(spark):
    day, made = D(2020, 4, 1), D(2019, 10, 1)
    obs = spark.createDataFrame(
        [("s", "a", day, 0.5), ("s", "b", day, math.nan), ("s", "c", day, None), ("s", "e", day, 0.1)],
        OBS,
    )
    pred = spark.createDataFrame(
        [("s", g, day, 0.4, "m", made, q) for g in "abcd" for q in (0.5, 0.025)], PRED
    )
    got = {r.geography: r.score_value for r in eos_abs_diff(obs, pred, ["season", "geography"]).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"] == pytest.approx(0.1) and math.isnan(got["b"])
    with pytest.raises(AssertionError):
        eos_abs_diff(obs, pred, ["geography"])


def test_forecasts_of_one_season_only(spark):
    two = spark.createDataFrame([(D(2019, 10, 1),), (D(2018, 10, 1),)], "forecast_date date")
    outside = spark.createDataFrame([(D(2019, 10, 1),), (D(2019, 6, 1),)], "forecast_date date")
    for bad in (two, outside):
        with pytest.raises(AssertionError):
            forecast_season(bad, SEASON)
    assert forecast_season(two.filter("forecast_date > '2019-01-01'"), SEASON) == "2019/2020"


@pytest.mark.parametrize(("height", "n", "want"), [(4, 3, [0, 2, 3]), (8, 5, [0, 2, 4, 5, 7]), (5, 5, [0, 1, 2, 3, 4])])
def test_gather_n(spark, height, n, want):
    df = spark.range(height).withColumn("v", -F.col("id")).repartition(3)
    assert sorted(r.id for r in ranking.gather_n(df, n, ["id"]).collect()) == want


def test_gather_n_limits(spark):
    with pytest.raises(AssertionError):
        ranking.gather_n(spark.range(5), 2, ["id"])
    with pytest.raises(AssertionError):
        ranking.gather_n(spark.range(2), 3, ["id"])


def test_row_index_and_best_worst(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.col("id") * 37, F.lit(101)))
    got = ranking.with_row_index(df, ["v", "id"]).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(1000))
    assert [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)
    scores = spark.createDataFrame(
        [("Dec", g, float(v)) for g, v in zip("edcba", (1, 1, 2, 3, 3))] + [("Nov", "z", 0.0)],
        "month string, geography string, score_value double",
    )
    out = ranking.best_and_worst(scores, "Dec", 2).orderBy("kind", "position").collect()
    assert [(r.kind, r.geography) for r in out] == [
        ("best", "d"), ("best", "e"), ("worst", "a"), ("worst", "b")
    ]
    with pytest.raises(ValueError):
        ranking.best_and_worst(scores, "Dec", 0)


def test_months_out_and_back(spark):
    rows = [("s", "a", 0, 0.1), ("s", "a", 2, None), ("s", "b", 1, 0.3)]
    df = spark.createDataFrame(rows, "season string, geography string, t int, estimate double")
    months = reshape.months_present(df)
    wide = reshape.pivot_months(df, months)
    assert wide.columns == ["season", "geography", "0", "1", "2"] and wide.count() == 2
    assert reshape.unpivot_months(wide, months).count() == 6
    twice = df.unionByName(df.limit(1))
    with pytest.raises(Exception, match="two rows for month"):
        reshape.pivot_months(twice, months).collect()
    with pytest.raises(AssertionError):
        require_no_nulls(wide)


def test_medians_equal_the_aggregate(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 2 == 0, "small").alias("g"),
        F.when(F.col("id") % 7 > 0, F.sin("id") * F.exp(F.col("id") % 11)).alias("v"),
    )
    df = df.unionByName(spark.sql("SELECT 'none' AS g, CAST(NULL AS DOUBLE) AS v"))
    want = {r.g: r.v for r in df.groupBy("g").agg(F.median("v").alias("v")).collect()}
    got = {r.g: r.v for r in medians.group_median(df, "g", "v").collect()}
    assert got == want and len(got) == 4


@pytest.mark.parametrize("copies", [1, 200])
def test_medians_of_odd_values_equal_the_aggregate(spark, copies):
    odd = {
        "nan": [1.0, float("nan"), 3.0, float("nan")],
        "more nan": [float("nan")] * 3 + [1.0],
        "up": [1.0, float("inf"), float("inf")],
        "both": [float("-inf"), float("inf")],
        "wide": [-1.7e308, 1.7e308, 1.6e308],
        "same": [5.0] * 9,
        "null": [None, None],
        "some": [None, 2.0, 4.0],
    }
    rows = [(g, v) for g, own in odd.items() for v in own] * copies
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    want = {r.g: repr(r.v) for r in df.groupBy("g").agg(F.median("v").alias("v")).collect()}
    got = {r.g: repr(r.v) for r in medians.group_median(df, "g", "v").collect()}
    assert got == want


def test_codes_count_from_zero_per_feature_and_panel(spark):
    df = spark.createDataFrame([("p", "b"), ("p", "c"), ("q", "c"), ("q", "c")], "panel string, g string")
    coded = encode.ordinal_codes(df, ["g"], ["panel"]).collect()
    assert sorted((r.panel, r.g, r.g_code) for r in coded) == [
        ("p", "b", 0), ("p", "c", 1), ("q", "c", 0), ("q", "c", 0)
    ]


def test_usable_forecasts_count_a_null_date(spark):
    cones = spark.createDataFrame(
        [("m", D(2020, 1, 1), D(2020, 2, 1), 0.1), ("m", D(2020, 1, 1), None, 0.1),
         ("n", D(2020, 1, 1), D(2020, 2, 1), 0.1), ("n", D(2020, 1, 1), D(2020, 3, 1), None)],
        "model string, forecast_date date, time_end date, pred_estimate double",
    )
    assert [r.model for r in report.usable_forecasts(cones).collect()] == ["m"]


def test_wanted_quantiles_must_be_there(spark):
    preds = spark.createDataFrame([(0.5,), (0.025,)], "quantile double")
    require_quantiles(preds, [0.5])
    with pytest.raises(AssertionError):
        require_quantiles(preds, [0.5, 0.975])
    with pytest.raises(Exception, match="unmapped quantile"):
        preds.withColumn("quantile", F.lit(0.3)).select(
            report.quantile_names(F.col("quantile"), 0.05)
        ).collect()
