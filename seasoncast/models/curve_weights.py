"""How far draws of the curve's posterior are from the posterior itself: importance weights.

Each draw's log posterior is the sum of its log prior and of the log likelihood of all training
rows, one aggregate over rows times draws. Less the log density that proposed the draw, it is the
log of the draw's weight. Effective draws and the tail index of the weights say whether the normal
approximation holds for a fit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasoncast.functions.curve import betabinom_loglik_terms, lpl_curve
from seasoncast.models import curve_math as cm
from seasoncast.models.curve_fit import _FLOOR
from seasoncast.models.curve_predict import (
    _draws_of_points,
    _drawn_points,
    _points_and_groups,
    _shares,
)
from seasoncast.models.curve_scales import generator
from seasoncast.sources.shared import cut_lineage

#: Draws of a fit that are checked, unless told otherwise.
CHECKED = 200


def _group_draws(
    groups: DataFrame, design: DataFrame, fit_keys: list[str], n_draws: int, seed: int
) -> DataFrame:
    """For each trained group its draws of A and M; a row without a geography holds the log prior
    of a shard's effects less the density of drawing them, by draw, in ``A``."""
    key = [*fit_keys, "shard"]
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [groups.schema[c] for c in [*fit_keys, "geography", "s"]]
        + [T.StructField("A", doubles), T.StructField("M", doubles)]
    )

    def draw(known: pd.DataFrame) -> pd.DataFrame:
        own = known[~known["is_point"]]
        if own.empty or not known["is_point"].any():
            return pd.DataFrame({c: pd.Series(dtype=object) for c in schema.names})
        drawn, place = _drawn_points(known, own["geography"].unique(), fit_keys, n_draws, seed)
        fit_name = [known.iloc[0][c] for c in fit_keys]
        rows, excess = [], np.zeros(n_draws)
        for name, at in place.items():
            rng = generator(seed, *fit_name, name)
            parts = []
            for d in drawn:
                geo, pair, density = cm.draw_effects(d.local, at, d.theta, d.thetas, rng)
                geo, pair = d.geo[at] + geo, d.pair[at] + pair
                shared = cm.on_own_scale(d.thetas)
                J = cm.season_design(pair.shape[1])
                am = np.einsum("sip,np->nsi", J, shared)[..., :2] + geo[:, None] + pair
                parts.append((am, cm.effects_density(geo, pair, density, d.sigma)))
            am, more = (np.concatenate(x) for x in zip(*parts))
            excess += more
            for s in sorted(map(int, own.loc[own["geography"] == name, "s"])):
                rows.append((*fit_name, name, s, am[:, s, 0], am[:, s, 1]))
        rows.append((*fit_name, None, None, excess, None))
        return pd.DataFrame(rows, columns=schema.names).astype({"s": "Int32"})

    together = _points_and_groups(design, groups, key)
    return cut_lineage(together.groupBy(*key).applyInPandas(draw, schema))


def _fit_draws(
    design: DataFrame, fit_keys: list[str], prior: dict[str, float], n_draws: int, seed: int
) -> DataFrame:
    """Draws of the shared parameters by fit, with log prior less log density and evidence."""
    names = ["muA", "muM", "K", "tau", "excess"]
    schema = T.StructType(
        [design.schema[c] for c in fit_keys]
        + [T.StructField("draw", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in names]
    )

    def draw(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("point")
        keys = [points.iloc[0][c] for c in fit_keys]
        used = points[_shares(points, n_draws) > 0]
        parts = []
        for row, (theta, thetas, sigma) in zip(
            used.itertuples(), _draws_of_points(points, n_draws, seed, keys)
        ):
            cov = np.asarray(row.cov, dtype=float).reshape(len(theta), len(theta))
            excess = cm.theta_density(thetas, theta, cov, sigma, prior) - row.evidence
            parts.append(np.column_stack([cm.natural(thetas), excess]))
        out = pd.DataFrame(np.concatenate(parts), columns=names)
        out.insert(0, "draw", np.arange(n_draws, dtype=np.int32))
        for i, (c, value) in enumerate(zip(fit_keys, keys)):
            out.insert(i, c, value)
        return out

    return cut_lineage(design.groupBy(*fit_keys).applyInPandas(draw, schema))


def draw_weights(
    obs: DataFrame,
    fits: DataFrame,
    groups: DataFrame,
    design: DataFrame,
    prior: dict[str, float],
    seed: int,
    group_cols: Sequence[str] = (),
    n_draws: int = CHECKED,
) -> DataFrame:
    """``draw, muA, muM, K, tau, log_weight`` of every fit; ``obs`` are its training rows.

    The likelihood is the beta-binomial one inside (0, 1); outside, the curve counts as at the edge,
    less the square of how far it is out.
    """
    fit_keys = [*group_cols, "forecast_date"]
    by_group = _group_draws(groups, design, fit_keys, n_draws, seed)
    by_fit = _fit_draws(design, fit_keys, prior, n_draws, seed)
    own = fits.select(*[F.col(c).alias(c) for c in [*fit_keys, "D"]])
    group = [*fit_keys, "geography", "s"]
    pairs = (
        obs.join(by_group.filter("s IS NOT NULL"), group)
        .select(*fit_keys, "t", "x", "n", "w", F.posexplode(F.arrays_zip("A", "M")).alias("draw", "g"))
        .select(*fit_keys, "t", "x", "n", "w", "draw", "g.A", "g.M")
        .join(by_fit.select(*fit_keys, "draw", "K", "tau"), [*fit_keys, "draw"])
        .join(own, fit_keys)
    )
    x, n, D = F.col("x"), F.col("n"), F.col("D")
    raw = lpl_curve(F.col("A"), F.col("M"), F.col("K"), F.col("tau"), F.col("t"))
    v = F.least(F.greatest(F.col("raw"), F.lit(_FLOOR)), F.lit(1 - _FLOOR))
    loglik = betabinom_loglik_terms(x, n, F.col("v") * D, (1 - F.col("v")) * D, D)
    outside = F.col("raw") - F.col("v")
    terms = pairs.withColumn("raw", raw).withColumn("v", v)
    likelihood = terms.groupBy(*fit_keys, "draw").agg(
        F.sum(F.col("w") * (loglik - n * outside * outside)).alias("loglik")
    )
    effects = (
        by_group.filter("s IS NULL")
        .select(*fit_keys, F.posexplode("A").alias("draw", "e"))
        .groupBy(*fit_keys, "draw")
        .agg(F.sum("e").alias("effects"))
    )
    return (
        by_fit.join(likelihood, [*fit_keys, "draw"])
        .join(effects, [*fit_keys, "draw"])
        .select(
            *fit_keys,
            "draw",
            "muA",
            "muM",
            "K",
            "tau",
            (F.col("excess") + F.col("loglik") + F.col("effects")).alias("log_weight"),
        )
    )


def weight_summary(weights: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``effective_draws, tail_index`` and ``corrected_<parameter>``, the weighted means, per fit."""
    fit_keys = [*group_cols, "forecast_date"]
    names = ["muA", "muM", "K", "tau"]
    schema = T.StructType(
        [weights.schema[c] for c in fit_keys]
        + [
            T.StructField(c, T.DoubleType())
            for c in ("effective_draws", "tail_index", *[f"corrected_{n}" for n in names])
        ]
    )

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        logs = rows["log_weight"].to_numpy()
        w = np.exp(logs - logs.max())
        w /= w.sum()
        out = rows[fit_keys].head(1).copy()
        out["effective_draws"] = 1 / (w**2).sum()
        out["tail_index"] = cm.tail_index(logs)
        for name in names:
            out[f"corrected_{name}"] = (w * rows[name].to_numpy()).sum()
        return out[schema.names]

    return weights.groupBy(*fit_keys).applyInPandas(summarise, schema)
