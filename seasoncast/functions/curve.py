"""The logistic-plus-line curve and its beta-binomial noise as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
_SHIFT = 8


def logistic(K: Column, tau: Column, t: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-K * (t - tau)))


def lpl_curve(A: Column, M: Column, K: Column, tau: Column, t: Column) -> Column:
    """Height ``A`` times a logistic in ``t``, plus slope ``M`` times ``t``. Not clamped."""
    return A * logistic(K, tau, t) + M * t


def _horner(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def lgamma(z: Column) -> Column:
    """Log of the gamma function for ``z > 0``: Stirling series after a shift by 8."""
    w = z + F.lit(float(_SHIFT))
    inv = F.lit(1.0) / w
    series = inv * _horner(
        inv * inv, [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
    )
    product = z
    for k in range(1, _SHIFT):
        product = product * (z + F.lit(float(k)))
    return (w - F.lit(0.5)) * F.log(w) - w + F.lit(_HALF_LOG_2PI) + series - F.log(product)


def digamma(z: Column) -> Column:
    """Derivative of :func:`lgamma`."""
    w = z + F.lit(float(_SHIFT))
    inv2 = F.lit(1.0) / (w * w)
    tail = F.lit(1.0) / z
    for k in range(1, _SHIFT):
        tail = tail + F.lit(1.0) / (z + F.lit(float(k)))
    series = inv2 * _horner(inv2, [1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132])
    return F.log(w) - F.lit(0.5) / w - series - tail


def trigamma(z: Column) -> Column:
    """Derivative of :func:`digamma`."""
    w = z + F.lit(float(_SHIFT))
    inv = F.lit(1.0) / w
    inv2 = inv * inv
    tail = F.lit(1.0) / (z * z)
    for k in range(1, _SHIFT):
        s = z + F.lit(float(k))
        tail = tail + F.lit(1.0) / (s * s)
    series = inv2 * _horner(inv2, [1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66])
    return inv + F.lit(0.5) * inv2 + inv * series + tail


def betabinom_loglik_terms(x: Column, n: Column, a: Column, b: Column, D: Column) -> Column:
    """The part of the log probability that depends on the parameters; ``a + b = D``."""
    return (
        (lgamma(x + a) - lgamma(a)) + (lgamma(n - x + b) - lgamma(b)) - (lgamma(n + D) - lgamma(D))
    )


def betabinom_logpmf(x: Column, n: Column, v: Column, D: Column) -> Column:
    """Log probability of ``x`` of ``n`` with mean ``v`` and concentration ``D``."""
    choose = lgamma(n + 1.0) - lgamma(x + 1.0) - lgamma(n - x + 1.0)
    return choose + betabinom_loglik_terms(x, n, v * D, (F.lit(1.0) - v) * D, D)


def betabinom_mean(n: Column, v: Column) -> Column:
    return v * n


def betabinom_variance(n: Column, v: Column, D: Column) -> Column:
    return v * (F.lit(1.0) - v) * n * (n + D) / (D + F.lit(1.0))
