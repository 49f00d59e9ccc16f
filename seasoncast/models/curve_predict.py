"""Quantiles of the latent curve over posterior draws.

The draws of a geography are made where its rows are, from a generator keyed by seed, fit
and geography: nothing the size of rows times draws is stored or shuffled, and a task that
runs again repeats its numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasoncast.models import curve_math as cm
from seasoncast.models.curve_fit import (
    _EFFECTS,
    _INFOS,
    _SCORES,
    _frame_arrays,
    by_shard,
    season_position,
)
from seasoncast.models.curve_scales import generator

PARAMETERS = ["muA", "muM", "K", "tau"]
FEATURES = ["season", "geography", "season_geo"]
SCALES = [f"sigma{p}_{f}" for p in "AM" for f in FEATURES]


def curve_quantiles(
    A: np.ndarray, M: np.ndarray, K: np.ndarray, tau: np.ndarray, t: np.ndarray, quantiles
) -> np.ndarray:
    """(quantile, row) quantiles over draws of ``A / (1 + exp(-K (t - tau))) + M t``.

    ``A`` and ``M`` are (draw, row); ``K`` and ``tau`` (draw,); ``t`` (row,).
    """
    values = A / (1 + np.exp(-K[:, None] * (t - tau[:, None]))) + M * t
    return np.quantile(values, quantiles, axis=0)


def predict_curves(
    rows: DataFrame,
    fits: DataFrame,
    groups: DataFrame,
    design: DataFrame,
    seasons: Sequence[str],
    quantiles: Sequence[float],
    n_draws: int,
    seed: int,
    group_cols: Sequence[str] = (),
    date_col: str = "time_end",
) -> DataFrame:
    """Forecast quantiles for every row of ``rows`` and every fit of its panel.

    Each point of the fit's ``design`` of scales has a share of the draws, by its weight. Groups
    without training rows get draws from their prior.
    """
    fit_keys = [*group_cols, "forecast_date"]
    key = [*fit_keys, "shard"]
    cell = [*group_cols, "geography", "season", "t", date_col]
    # Copies of a row are drawn once and repeated at the end.
    wanted = (
        rows.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("s", season_position(seasons, F.col("season")))
    )
    dates = fits.select(*fit_keys, "shards")
    wanted = wanted.join(dates, list(group_cols)) if group_cols else _beside(wanted, dates)
    wanted = wanted.withColumn(
        "shard", F.pmod(F.xxhash64("geography"), F.col("shards")).cast("int")
    ).select(*key, "geography", "season", "s", "t", date_col, "copies")

    trained = _points_and_groups(design, groups, key)
    kept = [*key, "geography", "season", date_col, "copies"]
    schema = T.StructType(
        [wanted.schema[c] for c in kept]
        + [T.StructField("quantile", T.DoubleType()), T.StructField("estimate", T.DoubleType())]
    )
    qs = [float(q) for q in quantiles]

    def predict(target: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        parts = list(_shard_forecast(target, known, fit_keys, qs, n_draws, seed))
        if not parts:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        estimates = pd.concat(parts)
        out = target[kept].loc[estimates["row"]].reset_index(drop=True)
        out["quantile"] = estimates["quantile"].to_numpy()
        out["estimate"] = estimates["estimate"].to_numpy()
        return out

    return (
        wanted.groupBy(*key)
        .cogroup(trained.groupBy(*key))
        .applyInPandas(predict, schema)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(*fit_keys, "season", "geography", "quantile", date_col, "estimate")
    )


def _beside(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """Each row once per fit of the only panel: the fits are as many as forecast dates."""
    listed = dates.agg(F.collect_list(F.struct(*dates.columns)))
    exploded = rows.withColumn("_fit", F.explode(listed.scalar()))
    return exploded.select(*rows.columns, "_fit.*")


_POINT = ["point", "weight", "sigma", "theta", "cov", "shift", "evidence"]


def _points_and_groups(design: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """Points of each fit once per shard, and its groups; ``is_point`` tells them apart."""
    points = by_shard(design).select(*key, *_POINT, F.lit(True).alias("is_point"))
    own = groups.drop("chunks").withColumn("is_point", F.lit(False))
    return points.unionByName(own, allowMissingColumns=True)


class _Drawn(NamedTuple):
    """A point of the design with its draws of the shared parameters, and the effects there."""

    local: cm.Local
    geo: np.ndarray
    pair: np.ndarray
    theta: np.ndarray
    thetas: np.ndarray
    sigma: np.ndarray


def _shares(points: pd.DataFrame, n_draws: int) -> np.ndarray:
    return cm.shares_of_draws(points["weight"].to_numpy(dtype=float), n_draws)


def _points_of(known: pd.DataFrame) -> pd.DataFrame:
    return known[known["is_point"]].sort_values("point")


def _draws_of_points(
    points: pd.DataFrame, n_draws: int, seed: int, names: list
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(mode, draws, scales) of the shared parameters at each point that has any draws."""
    for n, row in zip(_shares(points, n_draws), points.itertuples()):
        if n:
            theta = np.asarray(row.theta, dtype=float)
            cov = np.asarray(row.cov, dtype=float).reshape(len(theta), len(theta))
            rng = generator(seed, *names, int(row.point))
            yield theta, cm.draw_theta(theta, cov, n, rng), np.asarray(row.sigma, dtype=float)


def _drawn_points(
    known: pd.DataFrame, geographies: np.ndarray, fit_keys: list[str], n_draws: int, seed: int
) -> tuple[list[_Drawn], dict]:
    """Points with draws and their effects; places of the geographies in them.

    ``geographies`` without training rows join as rows of zeros: no information, so their prior.
    """
    points = _points_of(known)
    fit_name = [points.iloc[0][c] for c in fit_keys]
    trained = known[~known["is_point"]]
    names = pd.DataFrame({"geography": geographies, "s": 0})
    padded = pd.concat([trained, names[~names["geography"].isin(trained["geography"])]])
    sums = [*_EFFECTS, *_SCORES, *_INFOS]
    padded = padded[["geography", "s", *sums]].astype({c: float for c in sums})
    padded[sums] = padded[sums].fillna(0.0)
    padded = padded.astype({"s": int})
    n_seasons = (len(points.iloc[0]["theta"]) - 4) // 2
    _, order, score, info, geo, pair = _frame_arrays(padded, n_seasons)
    out = []
    used = points[_shares(points, n_draws) > 0]
    drawn = _draws_of_points(points, n_draws, seed, fit_name)
    for shift, (theta, thetas, sigma) in zip(used["shift"], drawn):
        local = cm.eliminate(score, info, geo, pair, sigma)
        moved = cm.moved_effects(local, geo, pair, np.asarray(shift, dtype=float), sigma)
        out.append(_Drawn(local, *moved, theta, thetas, sigma))
    return out, {name: i for i, name in enumerate(order)}


def _shard_forecast(
    target: pd.DataFrame,
    known: pd.DataFrame,
    fit_keys: list[str],
    quantiles: list[float],
    n_draws: int,
    seed: int,
) -> Iterator[pd.DataFrame]:
    if target.empty or known.empty:
        return
    drawn, place = _drawn_points(known, target["geography"].unique(), fit_keys, n_draws, seed)
    fit_name = [target.iloc[0][c] for c in fit_keys]
    for name, rows in target.groupby("geography", sort=True, dropna=False):
        rng = generator(seed, *fit_name, name)
        parts = [
            cm.draw_group(d.local, place[name], d.geo, d.pair, d.theta, d.thetas, rng) for d in drawn
        ]
        am, k_tau = (np.concatenate(x) for x in zip(*parts))
        s = rows["s"].to_numpy()
        values = curve_quantiles(
            am[:, s, 0], am[:, s, 1], k_tau[:, 0], k_tau[:, 1], rows["t"].to_numpy(), quantiles
        )
        yield pd.DataFrame(
            {
                "row": np.tile(rows.index.to_numpy(), len(quantiles)),
                "quantile": np.repeat(quantiles, len(rows)),
                "estimate": values.ravel(),
            }
        )


def effect_summary(
    groups: DataFrame,
    design: DataFrame,
    seasons: Sequence[str],
    n_draws: int,
    seed: int,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Mean, standard deviation and quantiles of every effect on A and M, per fit.

    ``feature`` is season, geography or season_geo; ``season`` and ``geography`` name the level.
    Effects of seasons are in each shard alike and are listed once.
    """
    fit_keys = [*group_cols, "forecast_date"]
    key = [*fit_keys, "shard"]
    schema = T.StructType(
        [groups.schema[c] for c in fit_keys]
        + [
            T.StructField("feature", T.StringType()),
            T.StructField("season", T.StringType()),
            groups.schema["geography"],
            T.StructField("parameter", T.StringType()),
            *[T.StructField(c, T.DoubleType()) for c in ("mean", "std", "q05", "median", "q95")],
        ]
    )
    labels = list(seasons)

    def described(values: np.ndarray) -> np.ndarray:
        """(statistic, level, parameter) of (draw, level, parameter)."""
        ends = np.quantile(values, [0.05, 0.5, 0.95], axis=0)
        return np.concatenate([[values.mean(axis=0), values.std(axis=0, ddof=1)], ends])

    def summarise(known: pd.DataFrame) -> pd.DataFrame:
        own = known[~known["is_point"]]
        if own.empty or not known["is_point"].any():
            return pd.DataFrame({c: pd.Series(dtype=object) for c in schema.names})
        drawn, place = _drawn_points(known, own["geography"].unique(), fit_keys, n_draws, seed)
        first = known.iloc[0]
        fit_name = [first[c] for c in fit_keys]
        rows: list[tuple] = []

        def listed(feature: str, names: list[tuple], values: np.ndarray) -> None:
            found = described(values)
            for level, (season, geography) in enumerate(names):
                for i, parameter in enumerate(("A", "M")):
                    rows.append((feature, season, geography, parameter, *found[:, level, i]))

        if first["shard"] == 0:
            both = np.concatenate([d.thetas[:, 4:] for d in drawn])
            by_season = both.reshape(len(both), 2, -1).transpose(0, 2, 1)
            listed("season", [(s, None) for s in labels], by_season)
        for name, at in place.items():
            rng = generator(seed, *fit_name, name)
            parts = [
                (d.geo[at] + g, d.pair[at] + p)
                for d in drawn
                for g, p, _ in [cm.draw_effects(d.local, at, d.theta, d.thetas, rng)]
            ]
            geo, pair = (np.concatenate(x) for x in zip(*parts))
            listed("geography", [(None, name)], geo[:, None])
            seen = sorted(map(int, own.loc[own["geography"] == name, "s"]))
            listed("season_geo", [(labels[s], name) for s in seen], pair[:, seen])
        out = pd.DataFrame(rows, columns=schema.names[len(fit_keys) :])
        for i, (c, value) in enumerate(zip(fit_keys, fit_name)):
            out.insert(i, c, value)
        return out

    together = _points_and_groups(design, groups, key)
    return together.groupBy(*key).applyInPandas(summarise, schema)


def posterior_draws(
    fits: DataFrame,
    design: DataFrame,
    n_draws: int,
    seed: int,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Draws of the shared parameters, the scales and D: one row per fit and draw."""
    fit_keys = [*group_cols, "forecast_date"]
    names = [*PARAMETERS, *SCALES, "D"]
    schema = T.StructType(
        [fits.schema[c] for c in fit_keys]
        + [T.StructField("draw", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in names]
    )

    def draw(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("point")
        keys = [points.iloc[0][c] for c in fit_keys]
        values = [
            np.concatenate([cm.natural(thetas), np.tile(sigma, (len(thetas), 1))], axis=1)
            for _, thetas, sigma in _draws_of_points(points, n_draws, seed, keys)
        ]
        rng = generator(seed, "D", *keys)
        D = points.iloc[0]["D"] * np.exp(points.iloc[0]["D_spread"] * rng.standard_normal(n_draws))
        out = pd.DataFrame(np.column_stack([np.concatenate(values), D]), columns=names)
        out.insert(0, "draw", np.arange(n_draws))
        for i, (c, value) in enumerate(zip(fit_keys, keys)):
            out.insert(i, c, value)
        return out

    own = fits.select(*[F.col(c).alias(c) for c in [*fit_keys, "D", "D_spread"]])
    return design.join(own, fit_keys).groupBy(*fit_keys).applyInPandas(draw, schema)


def posterior_summary(draws: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean, standard deviation and quantiles of each parameter and scale per fit."""
    fit_keys = [*group_cols, "forecast_date"]
    names = [*PARAMETERS, *SCALES, "D"]
    long = draws.unpivot([*fit_keys, "draw"], names, "parameter", "value")
    q05, median, q95 = (F.percentile("value", F.lit(q)) for q in (0.05, 0.5, 0.95))
    return long.groupBy(*fit_keys, "parameter").agg(
        F.avg("value").alias("mean"),
        F.stddev("value").alias("std"),
        q05.alias("q05"),
        median.alias("median"),
        q95.alias("q95"),
    )
