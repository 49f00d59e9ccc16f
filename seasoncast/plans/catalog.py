"""Named queries over the given tables, each with the SQL that checks it.

A query without SQL is one that SQL cannot state (model fits); tests check those.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasoncast.config import ModelConfig, interval_quantiles
from seasoncast.functions import curve
from seasoncast.functions.prior import log_prior
from seasoncast.functions.quantile import interpolated
from seasoncast.functions.season import (
    days_in_season,
    month_in_season,
    month_label,
    month_rank,
    season_geo,
    to_season,
)
from seasoncast.models import CurveModel, ForestModel, fit_all_models, predict_all_models
from seasoncast.models.curve import trajectory
from seasoncast.operators import encode, medians, prep, ranking, reshape
from seasoncast.operators.evaluate import eos_abs_diff, score_forecast_season
from seasoncast.operators.impute import knn_impute
from seasoncast.operators.last_date import rows_at_last_date
from seasoncast.plans import report
from seasoncast.schema import require_columns, require_no_nulls
from seasoncast.sources import tables
from seasoncast.sources.orders_panel import SEASON, orders_panel, table
from seasoncast.sources.shared import cut_lineage, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EXCLUDED = ("NATION_22", "NATION_23")
SCORED_SEASON = "1999/2000"
FORECAST_DATES = [dt.date(1999, 10, 1), dt.date(1999, 12, 1), dt.date(2000, 3, 1)]
ALPHA = 0.05
PANELS = ("o_orderpriority",)
# The published configuration of the curve's priors and draws.
PRIOR = {
    "seed": 42, "muA_shape1": 100.0, "muA_shape2": 180.0, "sigmaA_rate": 80.0,
    "tau_shape1": 100.0, "tau_shape2": 225.0, "K_shape": 150.0, "K_rate": 6.0,
    "muM_shape": 2.0, "muM_rate": 25.0, "sigmaM_rate": 80.0, "D_shape": 1000.0, "D_rate": 3.0,
    "num_samples": 500, "num_chains": 4,
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def season_sql(date: str) -> str:
    md, y = f"(month({date}) * 100 + day({date}))", f"year({date})"
    return (
        f"CASE WHEN {md} <= 401 THEN concat({y} - 1, '/', {y}) "
        f"WHEN {md} >= 701 THEN concat({y}, '/', {y} + 1) END"
    )


def _panel_sql(extra: str = "") -> str:
    cols = f"{extra}, " if extra else ""
    return f"""
monthly AS (
  SELECT {cols}c_nationkey, date_trunc('month', o_orderdate)::DATE AS time_end, count(*) AS n,
         count(*) FILTER (o_orderstatus = 'F') AS finished
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
labelled AS (
  SELECT {cols}n_name, time_end, n, finished, {season_sql("time_end")} AS s
  FROM monthly JOIN nation ON c_nationkey = n_nationkey),
est AS (
  SELECT *, (sum(finished) OVER (PARTITION BY {cols}s, n_name ORDER BY time_end))::DOUBLE
            / (sum(n) OVER (PARTITION BY {cols}s, n_name))::DOUBLE AS estimate
  FROM labelled),
panel AS (
  SELECT {cols}CASE WHEN n_name = 'NATION_24' THEN 'nation' ELSE 'admin1' END AS geography_type,
         n_name AS geography, time_end, estimate,
         greatest(estimate - 0.05::DOUBLE, 0::DOUBLE) AS lci,
         least(estimate + 0.05::DOUBLE, 1::DOUBLE) AS uci, n::INTEGER AS sample_size
  FROM est),
data AS (
  SELECT {cols}geography_type, geography, time_end, estimate, lci, uci, sample_size AS N_tot, season
  FROM (SELECT *, {season_sql("time_end")} AS season FROM panel)
  WHERE geography_type = 'admin1' AND geography NOT IN ('NATION_22', 'NATION_23')
    AND year(time_end) BETWEEN 1996 AND 2000 AND season IS NOT NULL)"""


DATA = "WITH " + _panel_sql()
MONTH = (
    "CAST(CASE WHEN month(time_end) >= 7 THEN month(time_end) - 7 ELSE month(time_end) + 5 END"
    " AS INTEGER)"
)
PREDS = f"""{DATA},
preds AS (
  SELECT m.model, f.forecast_date, season, geography, q.quantile, time_end,
         estimate * m.factor * q.factor AS estimate
  FROM data,
    (VALUES ('even', 1.1::DOUBLE), ('odd', 0.9::DOUBLE)) m(model, factor),
    (VALUES (DATE '1999-10-01'), (DATE '1999-12-01'), (DATE '2000-03-01')) f(forecast_date),
    (VALUES (0.5::DOUBLE, 1::DOUBLE), (0.025::DOUBLE, 0.8::DOUBLE), (0.975::DOUBLE, 1.2::DOUBLE))
      q(quantile, factor))"""


def clean_panel(spark: SparkSession, sf_dir: str, group_cols: tuple[str, ...] = ()) -> DataFrame:
    raw = orders_panel(spark, sf_dir, group_cols)
    return prep.preprocess(raw, SEASON, excluded=EXCLUDED)


def formula_predictions(data: DataFrame) -> DataFrame:
    """Predictions by a fixed rule: the estimate times a factor per model and quantile."""
    models = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(f).alias("factor"))
        for m, f in (("even", 1.1), ("odd", 0.9))
    ])
    quantiles = F.array(*[
        F.struct(F.lit(q).alias("quantile"), F.lit(f).alias("factor"))
        for q, f in zip(interval_quantiles(ALPHA), (1.0, 0.8, 1.2))
    ])
    return (
        data.withColumn("m", F.explode(models))
        .withColumn("forecast_date", F.explode(F.array(*[F.lit(d) for d in FORECAST_DATES])))
        .withColumn("q", F.explode(quantiles))
        .select(
            "m.model",
            "forecast_date",
            "season",
            "geography",
            "q.quantile",
            "time_end",
            (F.col("estimate") * F.col("m.factor") * F.col("q.factor")).alias("estimate"),
        )
    )


# Labels and dates ---------------------------------------------------------------------------


@query(
    "season_label",
    f"SELECT o_orderkey, {season_sql('o_orderdate')} AS season FROM orders",
)
def season_label(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", to_season(F.col("o_orderdate"), **SEASON.bounds).alias("season")
    )


@query(
    "days_in_season",
    """SELECT o_orderkey, CAST(d - CASE WHEN month(d) >= 7 THEN make_date(year(d), 7, 1)
         ELSE make_date(year(d) - 1, 7, 1) END AS INTEGER) AS days
       FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""",
)
def days_since_start(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", days_in_season(F.col("o_orderdate"), SEASON.start_month).alias("days")
    )


@query(
    "month_in_season",
    """SELECT o_orderkey, CAST((month(o_orderdate) + 5) % 12 AS INTEGER) AS t,
         CAST((month(o_orderdate) + 5) % 12 AS INTEGER) AS month_rank,
         strftime(o_orderdate, '%b') AS month FROM orders""",
)
def month_index(spark, sf_dir):
    first = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        month_in_season(first, SEASON.start_month).alias("t"),
        month_rank(first, SEASON.start_month).alias("month_rank"),
        month_label(first).alias("month"),
    )


@query(
    "forecast_dates",
    f"""{DATA}, ends AS (SELECT season, min(time_end) AS a, max(time_end) AS b FROM data GROUP BY 1)
       SELECT season, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE
         AS forecast_date FROM ends""",
)
def forecast_dates(spark, sf_dir):
    ends = clean_panel(spark, sf_dir).groupBy("season").agg(
        F.min("time_end").alias("a"), F.max("time_end").alias("b")
    )
    days = prep.date_range(F.col("a"), F.col("b"), "1mo")
    return ends.select("season", F.explode(days).alias("forecast_date"))


# Cleaning -----------------------------------------------------------------------------------


@query("preprocess_panel", f"{DATA} SELECT * FROM data")
def preprocess_panel(spark, sf_dir):
    return clean_panel(spark, sf_dir)


@query(
    "preprocess_geographies",
    f"""{DATA} SELECT * FROM data WHERE geography IN ('NATION_1', 'NATION_2', 'NATION_22')""",
)
def preprocess_geographies(spark, sf_dir):
    return prep.preprocess(
        orders_panel(spark, sf_dir),
        SEASON,
        geographies=["NATION_1", "NATION_2", "NATION_22"],
        excluded=EXCLUDED,
    )


@query(
    "extract_slice",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
       WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_tax = 0.02::DOUBLE
         AND l_linenumber IN (1, 2, 3)""",
)
def extract_slice(spark, sf_dir):
    return prep.extract_slice(
        table(spark, sf_dir, "lineitem"),
        equals={"l_returnflag": "R", "l_linestatus": "F", "l_tax": 0.02},
        members={"l_linenumber": [1, 2, 3]},
        columns=["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"],
        order_by=["l_orderkey", "l_linenumber"],
    )


@query(
    "training_snapshot",
    f"""{DATA} SELECT f.forecast_date, season, geography, time_end, estimate FROM data
       JOIN (VALUES (DATE '1999-10-01'), (DATE '1999-12-01'), (DATE '2000-03-01')) f(forecast_date)
       ON time_end <= f.forecast_date""",
)
def training_snapshot(spark, sf_dir):
    rows = prep.training_snapshots(clean_panel(spark, sf_dir), FORECAST_DATES)
    return rows.select("forecast_date", "season", "geography", "time_end", "estimate")


@query(
    "curve_columns",
    f"""{DATA} SELECT season, geography, time_end, round_even(N_tot * estimate, 0)::DOUBLE AS N_vax,
         season || '_' || geography AS season_geo,
         CAST(time_end - make_date(left(season, 4)::INTEGER, 7, 1) AS DOUBLE) / 365 AS t FROM data""",
)
def curve_columns(spark, sf_dir):
    return prep.curve_columns(clean_panel(spark, sf_dir), SEASON).select(
        "season", "geography", "time_end", "N_vax", "season_geo", "t"
    )


# Reshaping and encoding ---------------------------------------------------------------------


def _by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.month_column(clean_panel(spark, sf_dir), SEASON)


def _wide_sql(source: str = "data") -> str:
    cells = ", ".join(f"max(estimate) FILTER ({MONTH} = {m}) AS \"{m}\"" for m in range(10))
    return f"SELECT season, geography, {cells} FROM {source} GROUP BY ALL"


@query("wide_months", f"{DATA} {_wide_sql()}")
def wide_months(spark, sf_dir):
    rows = _by_month(spark, sf_dir)
    return reshape.pivot_months(rows, reshape.months_present(rows))


@query(
    "long_months",
    f"""{DATA}, wide AS ({_wide_sql()}),
       long AS (SELECT season, geography, t::BIGINT AS t, estimate FROM
         wide UNPIVOT INCLUDE NULLS (estimate FOR t IN ({", ".join(f'"{m}"' for m in range(10))}))),
       cross_dates AS (SELECT DISTINCT season, time_end, {MONTH} AS t FROM data)
       SELECT season, geography, t, estimate, time_end FROM long LEFT JOIN cross_dates USING (season, t)""",
)
def long_months(spark, sf_dir):
    rows = _by_month(spark, sf_dir)
    months = reshape.months_present(rows)
    long = reshape.unpivot_months(reshape.pivot_months(rows, months), months)
    return long.join(prep.date_crosswalk(rows), ["season", "t"], "left").select(
        "season", "geography", "t", "estimate", "time_end"
    )


@query(
    "ordinal_codes",
    f"""{DATA} SELECT season, geography, time_end,
         dense_rank() OVER (ORDER BY season) - 1 AS season_code,
         dense_rank() OVER (ORDER BY geography) - 1 AS geography_code,
         dense_rank() OVER (ORDER BY season || '_' || geography) - 1 AS season_geo_code FROM data""",
)
def ordinal_codes(spark, sf_dir):
    rows = clean_panel(spark, sf_dir).withColumn(
        "season_geo", season_geo(F.col("season"), F.col("geography"))
    )
    coded = encode.ordinal_codes(rows, ["season", "geography", "season_geo"])
    return coded.select(
        "season", "geography", "time_end", "season_code", "geography_code", "season_geo_code"
    )


@query(
    "level_counts",
    f"""WITH {_panel_sql("o_orderpriority")} SELECT o_orderpriority,
         count(DISTINCT season) AS n_season, count(DISTINCT geography) AS n_geography
       FROM data GROUP BY 1""",
)
def level_counts(spark, sf_dir):
    panels = ("o_orderpriority",)
    return encode.level_counts(
        clean_panel(spark, sf_dir, panels), ["season", "geography"], panels
    )


@query(
    "one_hot",
    f"""{DATA}, codes AS (SELECT season, geography, time_end,
         dense_rank() OVER (ORDER BY season) - 1 AS s,
         dense_rank() OVER (ORDER BY geography) - 1 AS g,
         (SELECT count(DISTINCT season) FROM data) AS ns FROM data)
       SELECT season, geography, time_end, unnest([s, ns + g])::INTEGER AS position, 1::DOUBLE AS value
       FROM codes""",
)
def one_hot(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows = clean_panel(spark, sf_dir).select("season", "geography", "time_end")
    encoder = encode.fit_one_hot(rows, ["season", "geography"], [])
    return (
        encode.encode_one_hot(encoder, rows)
        .select(
            "season",
            "geography",
            "time_end",
            F.posexplode(vector_to_array("features")).alias("position", "value"),
        )
        .filter("value <> 0")
    )


def _complete_sql() -> str:
    """CTEs up to ``full_cells``: every month of every row, gaps filled."""
    months = range(10)
    key = "o_orderpriority, season, geography"
    wide = ", ".join(f"max(estimate) FILTER ({MONTH} = {m}) AS m{m}" for m in months)
    total = " + ".join(f"coalesce((a.m{m} - b.m{m}) * (a.m{m} - b.m{m}), 0)" for m in months)
    common = " + ".join(f"(a.m{m} IS NOT NULL AND b.m{m} IS NOT NULL)::INTEGER" for m in months)
    cells = " UNION ALL ".join(
        f"SELECT {key}, {m} AS m, m{m} AS y FROM wide" for m in months
    )
    return f"""WITH {_panel_sql("o_orderpriority")},
wide AS (SELECT {key}, {wide} FROM data GROUP BY ALL),
cells AS ({cells}),
pairs AS (SELECT a.o_orderpriority, a.season, a.geography, b.season AS s2, b.geography AS g2,
    {total} AS total, {common} AS common FROM wide a JOIN wide b USING (o_orderpriority)),
ranked AS (SELECT c.o_orderpriority, c.season, c.geography, c.m, d.y,
    row_number() OVER (PARTITION BY c.o_orderpriority, c.season, c.geography, c.m
                       ORDER BY (10::DOUBLE / common) * total, d.y) AS place
  FROM cells c JOIN pairs p USING (o_orderpriority, season, geography)
  JOIN cells d ON d.o_orderpriority = p.o_orderpriority AND d.season = p.s2
    AND d.geography = p.g2 AND d.m = c.m
  WHERE c.y IS NULL AND d.y IS NOT NULL AND common > 0),
near AS (SELECT {key}, m, avg(y) AS y FROM ranked WHERE place <= 2 GROUP BY ALL),
means AS (SELECT o_orderpriority, m, avg(y) AS y FROM cells GROUP BY ALL),
full_cells AS (SELECT {key}, m, coalesce(c.y, n.y, a.y) AS y FROM cells c
  LEFT JOIN near n USING (o_orderpriority, season, geography, m) JOIN means a USING (o_orderpriority, m))"""


def _impute_sql() -> str:
    out = ", ".join(f"round(max(y) FILTER (m = {m}), 9) AS \"{m}\"" for m in range(10))
    return f"{_complete_sql()} SELECT o_orderpriority, season, geography, {out} FROM full_cells GROUP BY ALL"


@query("knn_impute", _impute_sql())
def imputed_months(spark, sf_dir):
    panels = ("o_orderpriority",)
    rows = prep.month_column(clean_panel(spark, sf_dir, panels), SEASON)
    months = reshape.months_present(rows)
    full = knn_impute(reshape.pivot_months(rows, months, group_cols=panels), months, panels)
    return full.select(
        "o_orderpriority",
        "season",
        "geography",
        *[F.round(F.col(str(m)), 9).alias(str(m)) for m in months],
    )


# End of season and scores -------------------------------------------------------------------


@query(
    "eos_rows_features",
    f"""{DATA} SELECT season, geography, time_end, estimate FROM data
       QUALIFY time_end = max(time_end) OVER (PARTITION BY season, geography)""",
)
def eos_rows_features(spark, sf_dir):
    last = rows_at_last_date(clean_panel(spark, sf_dir), ["season", "geography"])
    return last.select("season", "geography", "time_end", "estimate")


EOS = """eos AS (SELECT season, geography, time_end, estimate FROM data
       QUALIFY time_end = max(time_end) OVER (PARTITION BY season))"""


@query("eos_rows_season", f"{DATA}, {EOS} SELECT * FROM eos")
def eos_rows_season(spark, sf_dir):
    return report.end_of_season(clean_panel(spark, sf_dir)).select(
        "season", "geography", "time_end", "estimate"
    )


SCORES = f"""{PREDS},
last AS (SELECT season, geography, time_end, estimate FROM data
         QUALIFY time_end = max(time_end) OVER (PARTITION BY season, geography)),
scores AS (SELECT season, geography, model, forecast_date, 'eos_abs_diff' AS score_fun,
                  abs(p.estimate - o.estimate) AS score_value
           FROM last o JOIN preds p USING (season, geography, time_end)
           WHERE p.quantile = 0.5 AND p.estimate IS NOT NULL AND o.estimate IS NOT NULL)"""


@query("eos_abs_diff", f"{SCORES} SELECT * FROM scores")
def eos_scores(spark, sf_dir):
    data = clean_panel(spark, sf_dir)
    return eos_abs_diff(data, formula_predictions(data), ["season", "geography"])


@query(
    "score_forecast_season", f"{SCORES} SELECT * FROM scores WHERE season = '{SCORED_SEASON}'"
)
def scores_in_season(spark, sf_dir):
    data = clean_panel(spark, sf_dir)
    return score_forecast_season(data, formula_predictions(data), SEASON)


@query(
    "scores_filtered",
    f"""{SCORES} SELECT * FROM (SELECT * FROM scores UNION ALL
         SELECT season, geography, model, forecast_date, 'other', score_value FROM scores)
       WHERE score_fun = 'eos_abs_diff'""",
)
def scores_filtered(spark, sf_dir):
    data = clean_panel(spark, sf_dir)
    scores = eos_abs_diff(data, formula_predictions(data), ["season", "geography"])
    both = scores.unionByName(scores.withColumn("score_fun", F.lit("other")))
    return report.scores_of(both)


@query(
    "best_worst",
    f"""{SCORES}, month_scores AS (SELECT geography, score_value FROM scores
         WHERE strftime(forecast_date, '%b') = 'Dec' AND model = 'odd' AND season = '{SCORED_SEASON}'),
       best AS (SELECT 'best' AS kind, row_number() OVER (ORDER BY score_value, geography) - 1 AS p,
                geography FROM month_scores QUALIFY p < 4),
       worst AS (SELECT 'worst' AS kind,
                 row_number() OVER (ORDER BY score_value DESC, geography DESC) AS p, geography
                 FROM month_scores QUALIFY p <= 4)
       SELECT kind, p::INTEGER AS position, geography FROM best
       UNION ALL SELECT kind, (4 - p)::INTEGER, geography FROM worst""",
)
def best_worst(spark, sf_dir):
    data = clean_panel(spark, sf_dir)
    scores = score_forecast_season(data, formula_predictions(data), SEASON)
    one_model = scores.filter(F.col("model") == "odd").withColumn(
        "month", month_label(F.col("forecast_date"))
    )
    return ranking.best_and_worst(one_model, "Dec", 4)


# Report tables ------------------------------------------------------------------------------


@query(
    "trajectories",
    f"""{DATA} SELECT geography, time_end, estimate, strftime(time_end, '%b') AS month,
         {MONTH} AS month_rank FROM data WHERE season = '{SCORED_SEASON}'""",
)
def trajectories(spark, sf_dir):
    rows = report.trajectories(clean_panel(spark, sf_dir), SCORED_SEASON, SEASON)
    return rows.select("geography", "time_end", "estimate", "month", "month_rank")


@query(
    "gather_5",
    f"""{DATA}, last AS (SELECT geography, time_end, estimate FROM data
         WHERE season = '{SCORED_SEASON}' QUALIFY time_end = max(time_end) OVER ()),
       numbered AS (SELECT *, row_number() OVER (ORDER BY estimate, geography) - 1 AS i,
                    count(*) OVER () - 1 AS top FROM last)
       SELECT geography, time_end, estimate FROM numbered
       WHERE i IN (round_even(0 * top / 4.0, 0), round_even(1 * top / 4.0, 0),
                   round_even(2 * top / 4.0, 0), round_even(3 * top / 4.0, 0), top)""",
)
def gather_5(spark, sf_dir):
    rows = report.trajectories(clean_panel(spark, sf_dir), SCORED_SEASON, SEASON)
    return report.labelled_examples(rows, 5).select("geography", "time_end", "estimate")


@query(
    "row_index",
    """SELECT l_orderkey, l_linenumber,
         row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS row_index
       FROM lineitem""",
)
def row_index(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    order = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    return ranking.with_row_index(items, order).drop("l_extendedprice")


def _medians_sql(by: str) -> str:
    return f"""{DATA}, {EOS} SELECT {by}, round(estimate, 9) AS estimate, 'datum' AS type FROM eos
       UNION ALL SELECT {by}, round(median(estimate), 9), 'median' FROM eos GROUP BY {by}"""


def _with_medians(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    eos = report.end_of_season(clean_panel(spark, sf_dir))
    return report.add_medians(eos, by).withColumn("estimate", F.round("estimate", 9))


@query("add_medians_season", _medians_sql("season"))
def add_medians_season(spark, sf_dir):
    return _with_medians(spark, sf_dir, "season")


@query("add_medians_geography", _medians_sql("geography"))
def add_medians_geography(spark, sf_dir):
    return _with_medians(spark, sf_dir, "geography")


@query(
    "geographies_by_median",
    f"""{DATA}, {EOS} SELECT geography, round(median(estimate), 9) AS estimate FROM eos GROUP BY 1""",
)
def geographies_by_median(spark, sf_dir):
    eos = report.end_of_season(clean_panel(spark, sf_dir))
    return report.geographies_by_median(eos).withColumn("estimate", F.round("estimate", 9))


@query(
    "narrowed_median",
    """SELECT l_returnflag, round(median(l_extendedprice), 6) AS l_extendedprice
       FROM lineitem GROUP BY 1""",
)
def narrowed_median(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    exact = medians.group_median(items, "l_returnflag", "l_extendedprice")
    return exact.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


CONES = f"""{PREDS},
cones AS (SELECT model, forecast_date, geography, time_end,
    max(estimate) FILTER (quantile = 0.025) AS pred_lci,
    max(estimate) FILTER (quantile = 0.5) AS pred_estimate,
    max(estimate) FILTER (quantile = 0.975) AS pred_uci
  FROM preds WHERE time_end > forecast_date AND season = '{SCORED_SEASON}' GROUP BY ALL),
usable AS (SELECT model, forecast_date FROM cones WHERE pred_estimate IS NOT NULL
  GROUP BY ALL HAVING count(DISTINCT time_end) >= 2)"""


def _cones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    data = clean_panel(spark, sf_dir)
    return data, report.forecast_cones(formula_predictions(data), SEASON, ALPHA)


@query("forecast_cones", f"{CONES} SELECT * FROM cones")
def forecast_cones(spark, sf_dir):
    return _cones(spark, sf_dir)[1]


@query("usable_forecasts", f"{CONES} SELECT * FROM usable")
def usable_forecasts(spark, sf_dir):
    return report.usable_forecasts(_cones(spark, sf_dir)[1])


@query(
    "observations",
    f"""{DATA} SELECT geography, time_end, estimate AS obs_estimate, lci AS obs_lci, uci AS obs_uci
       FROM data WHERE season = '{SCORED_SEASON}'""",
)
def observations(spark, sf_dir):
    return report.observations(clean_panel(spark, sf_dir), SCORED_SEASON)


@query(
    "forecast_vs_observed",
    f"""{CONES} SELECT o.geography, o.time_end, o.estimate AS obs_estimate, o.lci AS obs_lci,
         o.uci AS obs_uci, u.model, u.forecast_date, pred_lci, pred_estimate, pred_uci
       FROM (SELECT * FROM data WHERE season = '{SCORED_SEASON}') o CROSS JOIN usable u
       LEFT JOIN cones c ON c.model = u.model AND c.forecast_date = u.forecast_date
         AND c.geography = o.geography AND c.time_end = o.time_end""",
)
def forecast_vs_observed(spark, sf_dir):
    data, cones = _cones(spark, sf_dir)
    return report.forecast_against_observed(report.observations(data, SCORED_SEASON), cones)


@query(
    "quantile_names",
    f"""{PREDS} SELECT model, forecast_date, geography, time_end, CASE quantile WHEN 0.025 THEN
         'pred_lci' WHEN 0.5 THEN 'pred_estimate' ELSE 'pred_uci' END AS quantile, estimate
       FROM preds WHERE season = '{SCORED_SEASON}'""",
)
def quantile_names(spark, sf_dir):
    rows = formula_predictions(clean_panel(spark, sf_dir)).filter(F.col("season") == SCORED_SEASON)
    return rows.drop("season").withColumn(
        "quantile", report.quantile_names(F.col("quantile"), ALPHA)
    )


@query("scan_raw", f"WITH {_panel_sql()} SELECT * FROM panel")
def scanned_raw(spark, sf_dir):
    """The raw panel, written and read with its declared schema."""
    path = scratch_path(spark, "raw")
    tables.write_table(orders_panel(spark, sf_dir), path)
    return tables.read_raw(spark, path)


@query("data_roundtrip", f"{DATA} SELECT * FROM data")
def data_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "data")
    tables.write_table(clean_panel(spark, sf_dir), path)
    return tables.read_data(spark, path)


@query("scores_roundtrip", f"{SCORES} SELECT * FROM scores")
def scores_roundtrip(spark, sf_dir):
    data, path = clean_panel(spark, sf_dir), scratch_path(spark, "scores")
    scores = eos_abs_diff(data, formula_predictions(data), ["season", "geography"])
    tables.write_table(scores, path)
    return tables.read_scores(spark, path)


@query("prediction_roundtrip", f"{PREDS} SELECT * FROM preds")
def prediction_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    tables.write_predictions(formula_predictions(clean_panel(spark, sf_dir)), path)
    return tables.read_predictions(spark, path)


# The curve ----------------------------------------------------------------------------------

CURVE = f"""{DATA}, timed AS (SELECT season, geography, time_end, N_tot::DOUBLE AS n,
    round_even(N_tot * estimate, 0)::DOUBLE AS x,
    CAST(time_end - make_date(left(season, 4)::INTEGER, 7, 1) AS DOUBLE) / 365 AS t FROM data),
curved AS (SELECT *, (0.36::DOUBLE / (1 + exp(-25::DOUBLE * (t - 0.31::DOUBLE)))) + 0.08::DOUBLE * t
    AS v FROM timed)"""


def _curved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.curve_columns(clean_panel(spark, sf_dir), SEASON)
    A, M, K, tau = (F.lit(x) for x in (0.36, 0.08, 25.0, 0.31))
    return rows.withColumn("v", curve.lpl_curve(A, M, K, tau, F.col("t")))


@query("lpl_curve", f"{CURVE} SELECT season, geography, time_end, round(v, 9) AS v FROM curved")
def lpl_curve(spark, sf_dir):
    return _curved(spark, sf_dir).select(
        "season", "geography", "time_end", F.round("v", 9).alias("v")
    )


@query(
    "betabinom_loglik",
    f"""{CURVE}, ab AS (SELECT *, v * 333::DOUBLE AS a, (1 - v) * 333::DOUBLE AS b FROM curved)
       SELECT season, geography, time_end,
         round(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + lgamma(x + a) - lgamma(a)
               + lgamma(n - x + b) - lgamma(b) - lgamma(n + 333) + lgamma(333::DOUBLE), 6) AS loglik,
         round(v * n, 9) AS mean, round(v * (1 - v) * n * (n + 333) / 334, 9) AS variance FROM ab""",
)
def betabinom_loglik(spark, sf_dir):
    n, x, v, D = F.col("N_tot").cast("double"), F.col("N_vax"), F.col("v"), F.lit(333.0)
    return _curved(spark, sf_dir).select(
        "season",
        "geography",
        "time_end",
        F.round(curve.betabinom_logpmf(x, n, v, D), 6).alias("loglik"),
        F.round(curve.betabinom_mean(n, v), 9).alias("mean"),
        F.round(curve.betabinom_variance(n, v, D), 9).alias("variance"),
    )


def _trajectory_sql(effects: dict[str, float]) -> str:
    codes = {
        "season": "season",
        "geography": "geography",
        "season_geo": "season || '_' || geography",
    }
    total = " + ".join(
        f"(dense_rank() OVER (ORDER BY {codes[f]})) * {c}::DOUBLE" for f, c in effects.items()
    )
    return f"""{CURVE}, am AS (SELECT *, {total} AS effect FROM timed)
       SELECT season, geography, time_end, round((0.36::DOUBLE + effect)
         / (1 + exp(-25::DOUBLE * (t - 0.31::DOUBLE))) + (0.08::DOUBLE + effect / 2) * t, 9) AS v
       FROM am"""


OWN_EFFECTS = {"season": 0.001, "geography": 0.0005, "season_geo": 0.0001}
SHARED_EFFECTS = {"season": 0.0002, "geography": 0.0002, "season_geo": 0.0002}


def _trajectory(spark: SparkSession, sf_dir: str, index: str, sizes: dict[str, float]) -> DataFrame:
    features = list(sizes)
    rows = prep.curve_columns(clean_panel(spark, sf_dir), SEASON)
    rows = cut_lineage(encode.ordinal_codes(rows, features))
    effects = None
    for feature, size in sizes.items():
        own = rows.select(
            F.lit(feature).alias("feature"),
            F.col(f"{feature}_code").alias("code"),
            ((F.col(f"{feature}_code") + 1) * size).alias("effect_A"),
        ).distinct()
        effects = own if effects is None else effects.unionByName(own)
    if index == "shared":
        effects = effects.withColumn("feature", F.lit("any")).distinct()
    effects = effects.withColumn("effect_M", F.col("effect_A") / 2)
    parameters = [F.lit(x) for x in (0.36, 0.08, 25.0, 0.31)]
    return trajectory(rows, effects, *parameters, effect_index=index).select(
        "season", "geography", "time_end", F.round("v", 9).alias("v")
    )


@query("lpl_trajectory", _trajectory_sql(OWN_EFFECTS))
def lpl_trajectory(spark, sf_dir):
    return _trajectory(spark, sf_dir, "per_feature", OWN_EFFECTS)


@query("lpl_trajectory_shared", _trajectory_sql(SHARED_EFFECTS))
def lpl_trajectory_shared(spark, sf_dir):
    return _trajectory(spark, sf_dir, "shared", SHARED_EFFECTS)


@query(
    "lpl_quantiles",
    f"""{CURVE}, draws AS (SELECT season, geography, time_end,
         (0.3::DOUBLE + 0.0001::DOUBLE * d + 0.01::DOUBLE * length(geography))
         / (1 + exp(-(20::DOUBLE + 0.005::DOUBLE * d) * (t - (0.3::DOUBLE + 0.00001::DOUBLE * d))))
         + (0.05::DOUBLE + 0.00002::DOUBLE * d) * t AS v
       FROM timed, range(2000) r(d)),
       found AS (SELECT season, geography, time_end, quantile_cont(v, [0.5, 0.025, 0.975]) AS qs
         FROM draws GROUP BY ALL)
       SELECT season, geography, time_end, unnest([0.5::DOUBLE, 0.025::DOUBLE, 0.975::DOUBLE])
         AS quantile, round(unnest(qs), 9) AS estimate FROM found""",
)
def lpl_quantiles(spark, sf_dir):
    quantiles = interval_quantiles(ALPHA)
    rows = prep.curve_columns(clean_panel(spark, sf_dir), SEASON)

    def latent(d):
        A = F.lit(0.3) + F.lit(0.0001) * d + F.lit(0.01) * F.length("geography")
        M, K, tau = F.lit(0.05) + F.lit(0.00002) * d, F.lit(20.0) + F.lit(0.005) * d, F.lit(0.3) + F.lit(0.00001) * d
        return curve.lpl_curve(A, M, K, tau, F.col("t"))

    numbers = F.sequence(F.lit(0), F.lit(1999))
    rows = rows.withColumn("_draws", F.array_sort(F.transform(numbers, latent)))
    estimates = F.array(*[interpolated(F.col("_draws"), q) for q in quantiles])
    named = F.arrays_zip(
        F.array(*[F.lit(q) for q in quantiles]).alias("quantile"), estimates.alias("estimate")
    )
    return rows.select("season", "geography", "time_end", F.explode(named).alias("q")).select(
        "season",
        "geography",
        "time_end",
        "q.quantile",
        F.round("q.estimate", 9).alias("estimate"),
    )


def _prior_sql() -> str:
    def beta(p: str, a: float, b: float) -> str:
        constant = f"lgamma({a + b}::DOUBLE) - lgamma({a}::DOUBLE) - lgamma({b}::DOUBLE)"
        return f"{constant} + {a - 1} * ln({p}) + {b - 1} * ln(1 - {p})"

    def gamma(x: str, shape: float, rate: float) -> str:
        return f"{shape} * ln({rate}::DOUBLE) - lgamma({shape}::DOUBLE) + {shape - 1} * ln({x}) - {rate} * {x}"

    scales = " + ".join(f"(ln(80::DOUBLE) - 80 * s{i})" for i in range(6))
    return f"""{DATA}, parts AS (SELECT geography, 0.2 + 0.5 * avg(estimate) AS mu_a, 0.01 + avg(uci - lci) AS mu_m,
         20 + 10 * max(estimate) AS k, 0.2 + 0.2 * min(uci) AS tau, 300 + count(*)::DOUBLE AS d,
         {", ".join(f"0.001 * (count(*) + {i}) AS s{i}" for i in range(6))} FROM data GROUP BY geography)
       SELECT geography, round({beta("mu_a", 100.0, 180.0)} + {beta("tau", 100.0, 225.0)} + {gamma("mu_m", 2.0, 25.0)}
         + {gamma("k", 150.0, 6.0)} + {gamma("d", 1000.0, 3.0)} + {scales}, 6) AS log_prior FROM parts"""


@query("log_prior", _prior_sql())
def prior_density(spark, sf_dir):
    """Log prior density at one set of parameters for every geography."""
    n = F.count(F.lit(1))
    parts = clean_panel(spark, sf_dir).groupBy("geography").agg(
        (0.2 + 0.5 * F.avg("estimate")).alias("muA"),
        (0.01 + F.avg(F.col("uci") - F.col("lci"))).alias("muM"),
        (20 + 10 * F.max("estimate")).alias("K"),
        (0.2 + 0.2 * F.min("uci")).alias("tau"),
        (300 + n.cast("double")).alias("D"),
        *[(0.001 * (n + i)).alias(f"s{i}") for i in range(6)],
    )
    shared = [F.col(c) for c in ("muA", "muM", "K", "tau", "D")]
    scales = [F.col(f"s{i}") for i in range(6)]
    density = log_prior(PRIOR, *shared, scales[:3], scales[3:])
    return parts.select("geography", F.round(density, 6).alias("log_prior"))


@query(
    "forecast_cutoffs",
    f"""{DATA} SELECT geography, time_end, season, {MONTH} AS month, season < '{SCORED_SEASON}' AS to_train,
         season >= '{SCORED_SEASON}' AS to_forecast FROM data""",
)
def forecast_cutoffs(spark, sf_dir):
    """What a forest knows of a forecast date, and which rows it trains on and forecasts."""
    day = F.col("time_end")
    label = to_season(day, **SEASON.bounds)
    return clean_panel(spark, sf_dir).select(
        "geography",
        "time_end",
        label.alias("season"),
        month_in_season(day, SEASON.start_month).alias("month"),
        (label < F.lit(SCORED_SEASON)).alias("to_train"),
        (label >= F.lit(SCORED_SEASON)).alias("to_forecast"),
    )


@query(
    "complete_panel",
    f"""{_complete_sql()} SELECT o_orderpriority, count(DISTINCT (season, geography)) AS n_rows,
         count(y) AS n_values, count(*) - count(y) AS n_nulls FROM full_cells GROUP BY ALL""",
)
def complete_panel(spark, sf_dir):
    """Rows and values of each panel after imputation, behind the checks for columns and nulls."""
    data = clean_panel(spark, sf_dir, PANELS)
    require_columns(data, [*PANELS, "season", "geography", "time_end", "estimate"])
    rows = prep.month_column(data, SEASON)
    months = reshape.months_present(rows)
    full = cut_lineage(
        knn_impute(reshape.pivot_months(rows, months, group_cols=PANELS), months, PANELS)
    )
    values = reduce(Column.__add__, [F.count(F.col(str(m))) for m in months])
    return require_no_nulls(full).groupBy(*PANELS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        values.alias("n_values"),
        (F.count(F.lit(1)) * len(months) - values).alias("n_nulls"),
    )


# Model fits: no SQL; simulated panels with known parameters check them. --------------------



def _fitted_curves(spark: SparkSession, sf_dir: str, panels: tuple[str, ...] = PANELS) -> CurveModel:
    # The panel is read many times, so it is built from the orders once.
    return CurveModel(
        data=cut_lineage(clean_panel(spark, sf_dir, panels)),
        forecast_dates=FORECAST_DATES,
        params=PRIOR,
        season=SEASON,
        quantiles=interval_quantiles(ALPHA),
        group_cols=panels,
    ).fit()


@query("curve_fit")
def curve_fit(spark, sf_dir):
    """Shared parameters of every panel and forecast date."""
    return _fitted_curves(spark, sf_dir).summary()


@query("curve_forecast")
def curve_forecast(spark, sf_dir):
    """Forecast quantiles of every panel and forecast date."""
    return _fitted_curves(spark, sf_dir).predict()


def _forest(
    spark: SparkSession, sf_dir: str, params: dict, panels: tuple[str, ...] = ()
) -> ForestModel:
    return ForestModel(
        data=cut_lineage(clean_panel(spark, sf_dir, panels)),
        forecast_dates=FORECAST_DATES,
        params=params,
        season=SEASON,
        quantiles=interval_quantiles(ALPHA),
        group_cols=panels,
    )


@query("forest_forecast")
def forest_forecast(spark, sf_dir):
    """Forecast quantiles of the later months by a forest."""
    return _forest(spark, sf_dir, {"n_estimators": 100, "seed": 1}).fit().predict()


# One split of the whole training table, found by trying every test on it.
STUMPS = """,
cutoffs(forecast_date, last_given) AS (VALUES (DATE '1999-10-01', 3), (DATE '1999-12-01', 5), (DATE '2000-03-01', 8)),
train AS (SELECT * FROM full_cells WHERE season < '1999/2000'),
places AS (SELECT DISTINCT o_orderpriority, season, geography FROM full_cells),
features AS (
  SELECT *, 0 AS f, season AS label, NULL::DOUBLE AS x FROM places
  UNION ALL SELECT *, 1, geography, NULL FROM places
  UNION ALL SELECT o_orderpriority, season, geography, 2 + m, NULL, y FROM full_cells),
sums AS (SELECT o_orderpriority, f, label, x, t.m, count(*) AS n, sum(t.y) AS p
  FROM features JOIN train t USING (o_orderpriority, season, geography) GROUP BY ALL),
tests AS (
  SELECT o_orderpriority, f, label, NULL::DOUBLE AS threshold, m, n, p FROM sums WHERE f < 2
  UNION ALL
  SELECT * FROM (SELECT o_orderpriority, f, NULL, (x + lead(x) OVER up) / 2 AS threshold, m,
    sum(n) OVER up AS n, sum(p) OVER up AS p FROM sums WHERE f >= 2
    WINDOW up AS (PARTITION BY o_orderpriority, f, m ORDER BY x)) WHERE threshold IS NOT NULL),
whole AS (SELECT o_orderpriority, m, count(*) AS n_all, sum(y) AS t, sum(y * y) AS q FROM train GROUP BY ALL),
losses AS (SELECT o_orderpriority, forecast_date, last_given, f, label, threshold,
    -round(sum(p * p / n + (t - p) * (t - p) / (n_all - n) - t * t / n_all) / sum(q - t * t / n_all), 9) AS loss
  FROM cutoffs JOIN tests ON m > last_given AND f <= 2 + last_given JOIN whole USING (o_orderpriority, m)
  WHERE n < n_all GROUP BY ALL),
splits AS (SELECT * FROM losses QUALIFY row_number() OVER
  (PARTITION BY o_orderpriority, forecast_date ORDER BY loss, f, label, threshold) = 1),
sides AS (SELECT o_orderpriority, season, geography, forecast_date, last_given,
    CASE WHEN s.f < 2 THEN r.label = s.label ELSE r.x > s.threshold END AS passes
  FROM splits s JOIN features r USING (o_orderpriority, f)),
leaves AS (SELECT o_orderpriority, forecast_date, passes, m, avg(y) AS estimate
  FROM sides JOIN train USING (o_orderpriority, season, geography) WHERE m > last_given GROUP BY ALL),
dated AS (SELECT DISTINCT o_orderpriority, season, time_end, {month} AS m FROM data),
stumps AS (SELECT o_orderpriority, forecast_date, season, geography, quantile, time_end, round(estimate, 9) AS estimate
  FROM sides JOIN leaves USING (o_orderpriority, forecast_date, passes)
    LEFT JOIN dated USING (o_orderpriority, season, m), (VALUES (0.5::DOUBLE), (0.025::DOUBLE), (0.975::DOUBLE)) AS q(quantile)
  WHERE season >= '1999/2000')
SELECT * FROM stumps"""
STUMP = {"n_estimators": 3, "bootstrap": False, "max_depth": 1}
STUMP_SQL = _complete_sql() + STUMPS.format(month=MONTH)


def _rounded(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn("estimate", F.round("estimate", 9))


@query("forest_stump", STUMP_SQL)
def forest_stump(spark, sf_dir):
    """Forecasts of every panel and date by trees of one split, which SQL finds by trying all."""
    return _rounded(_forest(spark, sf_dir, STUMP, PANELS).fit().predict())


@query("forest_reloaded", STUMP_SQL)
def forest_reloaded(spark, sf_dir):
    """The same from a model that was saved and loaded."""
    path = scratch_path(spark, "saved")
    _forest(spark, sf_dir, STUMP, PANELS).fit().save(path)
    return _rounded(_forest(spark, sf_dir, STUMP, PANELS).load(spark, path).predict())


@query(
    "stump_scores",
    STUMP_SQL.replace("SELECT * FROM stumps", "")
    + f"""SELECT o_orderpriority, season, geography, 'RFModel' AS model, forecast_date, 'eos_abs_diff' AS score_fun,
         round(abs(s.estimate - o.estimate), 6) AS score_value
       FROM stumps s JOIN (SELECT o_orderpriority, season, geography, time_end, estimate FROM data
         QUALIFY time_end = max(time_end) OVER (PARTITION BY o_orderpriority, season, geography)) o
       USING (o_orderpriority, season, geography, time_end) WHERE quantile = 0.5 AND season = '{SCORED_SEASON}'""",
)
def stump_scores(spark, sf_dir):
    """Configured models fitted by name for all panels and dates, forecast and scored."""
    data = cut_lineage(clean_panel(spark, sf_dir, PANELS))
    fitted = fit_all_models(
        data, FORECAST_DATES, [ModelConfig("RFModel", STUMP)], SEASON, interval_quantiles(ALPHA), PANELS
    )
    preds = cut_lineage(predict_all_models(fitted, PANELS))
    scores = score_forecast_season(data, preds, SEASON, [*PANELS, "season", "geography"])
    return scores.withColumn("score_value", F.round("score_value", 6))


@query("forecast_scores")
def forecast_scores(spark, sf_dir):
    """Both models fitted, forecast and scored at the end of the forecast season."""
    data = cut_lineage(clean_panel(spark, sf_dir))
    models = [ModelConfig("LPLModel", PRIOR), ModelConfig("RFModel", {"n_estimators": 100, "seed": 1})]
    fitted = fit_all_models(data, FORECAST_DATES, models, SEASON, interval_quantiles(ALPHA))
    return score_forecast_season(data, predict_all_models(fitted), SEASON)
