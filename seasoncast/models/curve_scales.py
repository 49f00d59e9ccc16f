"""Integration over the effect scales: a design of scales for each fit, weighted by evidence.

The group sums at the mode describe the likelihood as a parabola in each group's curve parameters.
For any scales, the effects and shared parameters that go with them then follow from these sums
alone, as does the evidence of the scales: no training row is read again. Points are drawn around
the mode of the scales, and each is weighted by its evidence over the density that proposed it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasoncast.models import curve_math as cm
from seasoncast.models.curve_fit import _frame_arrays, by_shard
from seasoncast.sources.shared import cut_lineage

#: Points of a fit, half of them opposite to the others.
POINTS = 32


def generator(seed: int, *names: object) -> np.random.Generator:
    return np.random.default_rng([seed, *[zlib.crc32(str(n).encode()) for n in names]])


def _proposed(fits: DataFrame, fit_keys: list[str], prior: dict, n: int, seed: int) -> DataFrame:
    """``n`` points of scales for each fit, with the place of the group sums (``at``)."""
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [fits.schema[c] for c in [*fit_keys, "shards"]]
        + [
            T.StructField("point", T.IntegerType()),
            T.StructField("at", doubles),
            T.StructField("sigma", doubles),
            T.StructField("proposed", T.DoubleType()),
        ]
    )

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                theta = np.asarray(row["theta"], dtype=float)
                # Sums were taken before the last step.
                own = cm.on_own_scale(theta) - np.asarray(row["shift"], dtype=float)
                at = np.concatenate([cm.unconstrained(own[:4]), own[4:]])
                rng = generator(seed, "scales", *[row[c] for c in fit_keys])
                sigma, proposed = cm.scale_points(
                    np.asarray(row["sigma"]), np.asarray(row["effective"]), prior, n, rng
                )
                out = pd.DataFrame({"point": np.arange(len(sigma), dtype=np.int32)})
                for c in [*fit_keys, "shards"]:
                    out[c] = [row[c]] * len(out)
                out["at"] = [at] * len(out)
                out["sigma"], out["proposed"] = list(sigma), proposed
                yield out[schema.names]

    columns = [*fit_keys, "shards", "theta", "shift", "sigma", "effective"]
    return cut_lineage(fits.select(*columns).mapInPandas(propose, schema))


def scale_design(
    fits: DataFrame,
    groups: DataFrame,
    fit_keys: list[str],
    prior: dict[str, float],
    seed: int,
    n_points: int = POINTS,
) -> DataFrame:
    """Points of every fit: ``point, weight, sigma, theta, cov, shift, evidence``, with ``shards``.

    The weights of a fit add up to 1. ``theta`` and ``cov`` are the mode and covariance of the shared
    parameters given the scales; ``shift`` is how far the mode lies from where the sums were taken.
    """
    points = _proposed(fits, fit_keys, prior, n_points, seed)
    key = [*fit_keys, "shard"]
    doubles = T.ArrayType(T.DoubleType())
    shared = [points.schema[c] for c in fit_keys]
    share_schema = T.StructType(
        [*shared, points.schema["point"], T.StructField("share", doubles)]
    )

    def share(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or own.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in share_schema.names})
        n_seasons = (len(own["at"].iloc[0]) - 4) // 2
        _, _, score, info, geo, pair = _frame_arrays(pdf, n_seasons)
        shares = []
        for sigma in own["sigma"]:
            local = cm.eliminate(score, info, geo, pair, np.asarray(sigma))
            shares.append(
                np.concatenate([local.information.ravel(), local.score, [local.evidence]])
            )
        return own[[*fit_keys, "point"]].assign(share=shares)

    shares = (
        groups.groupBy(*key)
        .cogroup(by_shard(points).groupBy(*key))
        .applyInPandas(share, share_schema)
    )
    solved_schema = T.StructType(
        [
            *[points.schema[c] for c in [*fit_keys, "shards", "point", "sigma"]],
            *[T.StructField(c, doubles) for c in ("theta", "cov", "shift")],
            T.StructField("evidence", T.DoubleType()),
            T.StructField("log_weight", T.DoubleType()),
        ]
    )

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        at, sigma = np.asarray(first["at"]), np.asarray(first["sigma"])
        total = np.sum(np.stack(rows["share"].to_list()), axis=0)
        p = len(at)
        information, score, local = total[: p * p].reshape(p, p), total[p * p : -1], total[-1]
        theta, cov = cm.update_theta(at, score, information, sigma, prior)
        evidence = local + cm.scale_evidence(at, score, information, sigma, prior)
        out = rows[[*fit_keys, "shards", "point"]].head(1).copy()
        out["sigma"], out["theta"], out["cov"] = [sigma], [theta], [cov.ravel()]
        out["shift"] = [cm.on_own_scale(theta) - cm.on_own_scale(at)]
        out["evidence"] = evidence
        out["log_weight"] = evidence - first["proposed"]
        return out[solved_schema.names]

    solved = cut_lineage(
        points.join(shares, [*fit_keys, "point"])
        .groupBy(*fit_keys, "point")
        .applyInPandas(solve, solved_schema)
    )
    of_fit = Window.partitionBy(*fit_keys)
    raw = F.exp(F.col("log_weight") - F.max("log_weight").over(of_fit))
    weighed = solved.withColumn("_raw", raw)
    weight = F.col("_raw") / F.sum("_raw").over(of_fit)
    return cut_lineage(weighed.withColumn("weight", weight).drop("_raw", "log_weight"))


def effective_points(design: DataFrame, fit_keys: list[str]) -> DataFrame:
    """How many equally weighted points a fit's design is worth."""
    return design.groupBy(*fit_keys).agg(
        (1 / F.sum(F.col("weight") * F.col("weight"))).alias("effective_points")
    )
