"""Log densities of the curve's priors as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_logpdf(p: Column, shape1: float, shape2: float) -> Column:
    constant = math.lgamma(shape1 + shape2) - math.lgamma(shape1) - math.lgamma(shape2)
    return F.lit(constant) + (shape1 - 1) * F.log(p) + (shape2 - 1) * F.log1p(-p)


def gamma_logpdf(x: Column, shape: float, rate: float) -> Column:
    constant = shape * math.log(rate) - math.lgamma(shape)
    return F.lit(constant) + (shape - 1) * F.log(x) - rate * x


def exponential_logpdf(x: Column, rate: float) -> Column:
    return F.lit(math.log(rate)) - rate * x


def normal_logpdf(x: Column, spread: Column | None = None) -> Column:
    """Normal around 0, standard without ``spread``."""
    half = 0.5 * math.log(2 * math.pi)
    if spread is None:
        return -F.lit(half) - 0.5 * x * x
    return -F.lit(half) - F.log(spread) - 0.5 * (x / spread) * (x / spread)


def log_prior(
    prior: dict[str, float],
    muA: Column,
    muM: Column,
    K: Column,
    tau: Column,
    D: Column,
    sigmaA: Sequence[Column],
    sigmaM: Sequence[Column],
) -> Column:
    """Log prior density of the shared parameters and scales."""
    total = (
        beta_logpdf(muA, prior["muA_shape1"], prior["muA_shape2"])
        + beta_logpdf(tau, prior["tau_shape1"], prior["tau_shape2"])
        + gamma_logpdf(muM, prior["muM_shape"], prior["muM_rate"])
        + gamma_logpdf(K, prior["K_shape"], prior["K_rate"])
        + gamma_logpdf(D, prior["D_shape"], prior["D_rate"])
    )
    for scales, rate in ((sigmaA, prior["sigmaA_rate"]), (sigmaM, prior["sigmaM_rate"])):
        for scale in scales:
            total = total + exponential_logpdf(scale, rate)
    return total
