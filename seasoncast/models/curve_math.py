"""Small dense algebra of the hierarchical curve, on sums that Spark has already aggregated.

A fit has shared parameters ``theta = (logit muA, log muM, log K, logit tau, season effects
on A, season effects on M)``. Geography effects and season-geography effects touch a single
geography, so they are eliminated geography by geography; what remains is the score and
information of ``theta``, whose size depends on the number of seasons alone.

``sigma`` holds the effect scales in the order season, geography, season-geography, first
for A and then for M.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def natural(theta: np.ndarray) -> np.ndarray:
    """(muA, muM, K, tau) on their own scales; ``theta`` may carry leading axes."""
    u = theta[..., :4]
    unit = 1 / (1 + np.exp(-u[..., [0, 3]]))
    return np.stack([unit[..., 0], np.exp(u[..., 1]), np.exp(u[..., 2]), unit[..., 1]], axis=-1)


def on_own_scale(theta: np.ndarray) -> np.ndarray:
    """``theta`` with its first four entries on their own scales."""
    return np.concatenate([natural(theta), theta[..., 4:]], axis=-1)


def slope_of_natural(theta: np.ndarray) -> np.ndarray:
    """Derivative of :func:`on_own_scale`, entry by entry."""
    mu_a, mu_m, K, tau = natural(theta)
    out = np.ones(len(theta))
    out[:4] = [mu_a * (1 - mu_a), mu_m, K, tau * (1 - tau)]
    return out


def season_design(n_seasons: int) -> np.ndarray:
    """(season, (A, M, K, tau), theta) design of the shared part of a group."""
    out = np.zeros((n_seasons, 4, 4 + 2 * n_seasons))
    out[:, np.arange(4), np.arange(4)] = 1.0
    each = np.arange(n_seasons)
    out[each, 0, 4 + each] = 1.0
    out[each, 1, 4 + n_seasons + each] = 1.0
    return out


@dataclass
class Local:
    """Geographies of a shard after elimination.

    ``geo`` (B, 2) and ``pair`` (B, S, 2) are Newton steps of the effects on (A, M) for an
    unchanged ``theta``; the covariances are conditional; the slopes say how far the effects
    give way when ``theta`` (B, 2, P) or a group's (A, M, K, tau) (B, S, 2, 4) moves. ``evidence``
    is the log of the integral over the effects for an unchanged ``theta``, up to a constant that
    does not depend on the scales.
    """

    geo: np.ndarray
    pair: np.ndarray
    geo_cov: np.ndarray
    pair_cov: np.ndarray
    geo_slope: np.ndarray
    pair_slope: np.ndarray
    score: np.ndarray
    information: np.ndarray
    evidence: float


def eliminate(
    score: np.ndarray,
    info: np.ndarray,
    geo: np.ndarray,
    pair: np.ndarray,
    sigma: np.ndarray,
) -> Local:
    """Eliminate the local effects from group sums ``score`` (B, S, 4) and ``info`` (B, S, 4, 4)."""
    prior_geo, prior_pair = sigma[[1, 4]] ** -2.0, sigma[[2, 5]] ** -2.0
    J = season_design(info.shape[1])
    pair_cov = np.linalg.inv(info[..., :2, :2] + np.diag(prior_pair))
    pair_slope = pair_cov @ info[..., :2, :]
    own = score[..., :2] - prior_pair * pair
    r = score - np.einsum("bsip,bsi->bsp", pair_slope, own)
    R = info - np.einsum("bsip,bsiq->bspq", info[..., :2, :], pair_slope)
    q = r[..., :2].sum(axis=1) - prior_geo * geo
    geo_cov = np.linalg.inv(R[..., :2, :2].sum(axis=1) + np.diag(prior_geo))
    coupling = np.einsum("sip,bsij->bpj", J, R[..., :2])
    geo_slope = np.einsum("bij,bpj->bip", geo_cov, coupling)
    geo_step = np.einsum("bij,bj->bi", geo_cov, q)
    pair_step = np.einsum("bsij,bsj->bsi", pair_cov, own) - np.einsum(
        "bsij,bj->bsi", pair_slope[..., :2], geo_step
    )
    information = np.einsum("sip,sij,sjq->pq", J, R.sum(axis=0), J, optimize=True)
    information -= np.einsum("bpj,bjq->pq", coupling, geo_slope)
    theta_score = np.einsum("sip,si->p", J, r.sum(axis=0)) - np.einsum("bjp,bj->p", geo_slope, q)
    evidence = 0.0
    for gradient, cov, effects, precision in (
        (own, pair_cov, pair, prior_pair),
        (q, geo_cov, geo, prior_geo),
    ):
        gain = np.einsum("...i,...ij,...j->...", gradient, cov, gradient)
        evidence += 0.5 * (gain + np.linalg.slogdet(cov)[1]).sum()
        evidence += 0.5 * (np.log(precision) - precision * effects**2).sum()
    return Local(
        geo_step,
        pair_step,
        geo_cov,
        pair_cov,
        geo_slope,
        pair_slope,
        theta_score,
        information,
        float(evidence),
    )


def moved_effects(
    local: Local, geo: np.ndarray, pair: np.ndarray, shift: np.ndarray, sigma: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Effects after their Newton step and after following ``theta``, which moved by ``shift``."""
    J = season_design(pair.shape[1])
    back = local.geo_slope @ shift
    geo_step = local.geo - back
    group_shift = np.broadcast_to(J @ shift, (len(geo), pair.shape[1], 4)).copy()
    group_shift[..., :2] -= back[:, None]
    pair_step = local.pair - np.einsum("bsij,bsj->bsi", local.pair_slope, group_shift)
    reach_geo, reach_pair = 3 * sigma[[1, 4]], 3 * sigma[[2, 5]]
    return (
        geo + np.clip(geo_step, -reach_geo, reach_geo),
        pair + np.clip(pair_step, -reach_pair, reach_pair),
    )


def scale_sums(
    local: Local, geo: np.ndarray, pair: np.ndarray, cov: np.ndarray, sigma: np.ndarray
) -> np.ndarray:
    """Per scale (geography A, pair A, geography M, pair M): sum of squares, effective number.

    ``cov`` is that of ``theta`` on its own scale; the variances include what it adds.
    """
    J = season_design(pair.shape[1])
    var_geo = np.einsum("bii->bi", local.geo_cov) + np.einsum(
        "bip,pq,biq->bi", local.geo_slope, cov, local.geo_slope, optimize=True
    )
    shared = np.broadcast_to(J, (len(geo), *J.shape)).copy()
    shared[:, :, :2] -= local.geo_slope[:, None]
    follow = local.pair_slope @ shared
    through_geo = local.pair_slope[..., :2] @ local.geo_cov[:, None]
    var_pair = (
        np.einsum("bsii->bsi", local.pair_cov)
        + ((follow @ cov) * follow).sum(-1)
        + (through_geo * local.pair_slope[..., :2]).sum(-1)
    )
    out = []
    for i in (0, 1):
        for effects, variance, scale in (
            (geo[:, i], var_geo[:, i], sigma[3 * i + 1]),
            (pair[..., i], var_pair[..., i], sigma[3 * i + 2]),
        ):
            out += [(effects**2).sum(), (1 - variance / scale**2).sum()]
    return np.array(out)


def scale_pull(sum_squares: float, effective: float, sigma: float, rate: float) -> float:
    """How far log sigma is from its mode, with an exponential prior on sigma: slope of its log
    density over an estimate of the curvature, which does not vanish where a scale is barely known."""
    slope = sum_squares / sigma**2 - effective + 1 - rate * sigma
    return float(slope / max(2 * effective + rate * sigma, 1.0))


def secant_slope(pull: np.ndarray, last_pull: np.ndarray, last_step: np.ndarray) -> np.ndarray:
    """By how much of a step the pull gives way, entry by entry, as seen in the last step.

    Below one where the last step hardly changed the pull, above where it turned it around.
    """
    known = np.abs(last_step) > 1e-4
    slope = np.where(known, (last_pull - pull) / np.where(known, last_step, 1.0), 1.0)
    return np.clip(slope, 0.25, 4.0)


def damping(step: np.ndarray, last_step: np.ndarray, last_damping: float, cov: np.ndarray) -> float:
    """Part of a Newton step to go, as the last one went too far or not.

    The information leaves out the bend of the curve in K and tau. Where many observations speak
    against the curve, whole steps overshoot by more than they mend.
    """
    weight = np.linalg.solve(cov, last_step)
    length = last_damping * float(weight @ last_step)
    bend = float(weight @ (last_step - step)) / length if length > 1e-12 else 1.0
    return float(np.clip(1 / bend, 0.1, 1.0)) if bend > 1 else 1.0


def _theta_system(
    theta: np.ndarray, score: np.ndarray, information: np.ndarray, sigma: np.ndarray, prior: dict
) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and covariance on the unconstrained scale, priors included."""
    n_seasons = (len(theta) - 4) // 2
    mu_a, mu_m, K, tau = natural(theta)
    scale = slope_of_natural(theta)
    grad, info = score * scale, information * np.outer(scale, scale)
    for i, p, name in ((0, mu_a, "muA"), (3, tau, "tau")):
        one, two = prior[f"{name}_shape1"], prior[f"{name}_shape2"]
        grad[i] += one - (one + two) * p
        info[i, i] += (one + two) * p * (1 - p)
    for i, value, name in ((1, mu_m, "muM"), (2, K, "K")):
        grad[i] += prior[f"{name}_shape"] - prior[f"{name}_rate"] * value
        info[i, i] += prior[f"{name}_rate"] * value
    precision = np.repeat(sigma[[0, 3]] ** -2.0, n_seasons)
    grad[4:] -= precision * theta[4:]
    info[4:, 4:] += np.diag(precision)
    cov = np.linalg.inv((info + info.T) / 2)
    return grad, (cov + cov.T) / 2


def update_theta(
    theta: np.ndarray, score: np.ndarray, information: np.ndarray, sigma: np.ndarray, prior: dict
) -> tuple[np.ndarray, np.ndarray]:
    """One Newton step on the unconstrained scale: (new theta, covariance)."""
    n_seasons = (len(theta) - 4) // 2
    grad, cov = _theta_system(theta, score, information, sigma, prior)
    step = cov @ grad
    step[:4] = np.clip(step[:4], -0.3, 0.3)
    reach = 3 * np.repeat(sigma[[0, 3]], n_seasons)
    step[4:] = np.clip(step[4:], -reach, reach)
    return theta + step, cov


def scale_evidence(
    theta: np.ndarray, score: np.ndarray, information: np.ndarray, sigma: np.ndarray, prior: dict
) -> float:
    """Log of the integral over ``theta`` with the scales' prior, on the log scale, up to a constant.

    ``score`` and ``information`` are those left when the local effects are eliminated at ``sigma``.
    """
    n_seasons = (len(theta) - 4) // 2
    grad, cov = _theta_system(theta, score, information, sigma, prior)
    spread = np.repeat(sigma[[0, 3]], n_seasons)
    out = 0.5 * (grad @ cov @ grad + np.linalg.slogdet(cov)[1])
    out -= (np.log(spread) + 0.5 * (theta[4:] / spread) ** 2).sum()
    return float(out + (np.log(sigma) - scale_rates(prior) * sigma).sum())


def scale_rates(prior: dict) -> np.ndarray:
    return np.repeat([prior["sigmaA_rate"], prior["sigmaM_rate"]], 3)


def unconstrained(natural_values: np.ndarray) -> np.ndarray:
    """The first four entries of ``theta`` from (muA, muM, K, tau)."""
    mu_a, mu_m, K, tau = natural_values
    return np.array([np.log(mu_a / (1 - mu_a)), np.log(mu_m), np.log(K), np.log(tau / (1 - tau))])


def scale_points(
    sigma: np.ndarray, effective: np.ndarray, prior: dict, n: int, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) scales around their mode and the log density, up to a constant, of proposing each.

    On the log scale they are normal, a quarter wider than the curvature says, in opposite pairs.
    ``effective`` is the effective number of effects of each scale.
    """
    curvature = 2 * np.maximum(effective, 0.0) + scale_rates(prior) * sigma
    spread = 1.25 / np.sqrt(np.maximum(curvature, 0.5))
    half = rng.standard_normal((n // 2, len(sigma)))
    z = np.concatenate([half, -half])
    return sigma * np.exp(z * spread), -0.5 * (z**2).sum(axis=1)


def shares_of_draws(weights: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` draws each point gets: evenly spaced marks on the summed weights."""
    ends = np.cumsum(weights) / np.sum(weights)
    marks = (np.arange(n) + 0.5) / n
    return np.bincount(np.minimum(np.searchsorted(ends, marks), len(ends) - 1), minlength=len(ends))


def update_concentration(
    D: float, score: float, information: float, prior: dict
) -> tuple[float, float]:
    """D after one damped Newton step of log D with its gamma prior, and the spread of log D."""
    grad = D * score + prior["D_shape"] - prior["D_rate"] * D
    info = max(D * D * information - D * score, 0.0) + prior["D_rate"] * D
    return float(D * np.exp(np.clip(grad / info, -0.3, 0.3))), float(info**-0.5)


def log_prior(theta: np.ndarray, sigma: np.ndarray, D: float, prior: dict) -> float:
    """Log density of shared parameters, season effects and scales, up to a constant."""
    mu_a, mu_m, K, tau = natural(theta)
    out = 0.0
    for p, name in ((mu_a, "muA"), (tau, "tau")):
        out += (prior[f"{name}_shape1"] - 1) * np.log(p)
        out += (prior[f"{name}_shape2"] - 1) * np.log1p(-p)
    for value, name in ((mu_m, "muM"), (K, "K"), (D, "D")):
        out += (prior[f"{name}_shape"] - 1) * np.log(value) - prior[f"{name}_rate"] * value
    out -= prior["sigmaA_rate"] * sigma[:3].sum() + prior["sigmaM_rate"] * sigma[3:].sum()
    scales = np.repeat(sigma[[0, 3]], (len(theta) - 4) // 2)
    return float(out - 0.5 * ((theta[4:] / scales) ** 2).sum() - np.log(scales).sum())


def draw_theta(theta: np.ndarray, cov: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """(n, P) draws on the unconstrained scale."""
    root = np.linalg.cholesky(cov + 1e-12 * np.eye(len(theta)) * np.diag(cov))
    return theta + rng.standard_normal((n, len(theta))) @ root.T


def draw_effects(
    local: Local,
    at: int,
    theta: np.ndarray,
    thetas: np.ndarray,
    rng: np.random.Generator,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deviations of the effects of geography ``at`` from their mode, jointly with ``thetas``:
    (n, 2) of its own and (n, S, 2) of its seasons, and the log density (n,) of drawing them."""
    n_seasons = local.pair_cov.shape[1]
    J = season_design(n_seasons)
    shift = on_own_scale(thetas) - on_own_scale(theta)
    z_geo = rng.standard_normal((len(shift), 2))
    z_pair = rng.standard_normal((len(shift), n_seasons, 2))
    geo_root = np.linalg.cholesky(local.geo_cov[at])
    pair_roots = np.linalg.cholesky(local.pair_cov[at])
    geo_part = -shift @ local.geo_slope[at].T + z_geo @ geo_root.T
    group = np.einsum("sip,np->nsi", J, shift)
    group[..., :2] += geo_part[:, None]
    pair_part = -np.einsum("sij,nsj->nsi", local.pair_slope[at], group)
    pair_part += np.einsum("sij,nsj->nsi", pair_roots, z_pair)
    log_density = -0.5 * (z_geo**2).sum(axis=1) - 0.5 * (z_pair**2).sum(axis=(1, 2))
    log_density -= np.log(np.diag(geo_root)).sum()
    log_density -= np.log(np.einsum("sii->si", pair_roots)).sum()
    return geo_part, pair_part, log_density


def draw_group(
    local: Local,
    at: int,
    geo: np.ndarray,
    pair: np.ndarray,
    theta: np.ndarray,
    thetas: np.ndarray,
    rng: np.random.Generator,
) -> tuple[np.ndarray, np.ndarray]:
    """(n, S, 2) draws of (A, M) of geography ``at`` and (n, 2) of (K, tau), jointly with ``thetas``."""
    geo_part, pair_part, _ = draw_effects(local, at, theta, thetas, rng)
    own = on_own_scale(thetas)
    shared = np.einsum("sip,np->nsi", season_design(pair.shape[1]), own)
    am = shared[..., :2] + (geo[at] + geo_part)[:, None] + pair[at] + pair_part
    return am, own[:, 2:4]


def theta_density(
    thetas: np.ndarray, theta: np.ndarray, cov: np.ndarray, sigma: np.ndarray, prior: dict
) -> np.ndarray:
    """(n,) log prior of draws on the unconstrained scale less the log density of drawing them."""
    mu_a, mu_m, K, tau = natural(thetas).T
    out = np.zeros(len(thetas))
    for p, name in ((mu_a, "muA"), (tau, "tau")):
        out += prior[f"{name}_shape1"] * np.log(p) + prior[f"{name}_shape2"] * np.log1p(-p)
    for value, name in ((mu_m, "muM"), (K, "K")):
        out += prior[f"{name}_shape"] * np.log(value) - prior[f"{name}_rate"] * value
    spread = np.repeat(sigma[[0, 3]], (len(theta) - 4) // 2)
    out -= (0.5 * (thetas[:, 4:] / spread) ** 2 + np.log(spread)).sum(axis=1)
    out += (np.log(sigma) - scale_rates(prior) * sigma).sum()
    gap = thetas - theta
    out += 0.5 * (gap * np.linalg.solve(cov, gap.T).T).sum(axis=1)
    return out + 0.5 * np.linalg.slogdet(cov)[1]


def effects_density(
    geo: np.ndarray, pair: np.ndarray, log_drawn: np.ndarray, sigma: np.ndarray
) -> np.ndarray:
    """(n,) log prior of a geography's effects (n, 2) and (n, S, 2) less that of drawing them."""
    own, both = sigma[[1, 4]], sigma[[2, 5]]
    out = -(0.5 * (geo / own) ** 2 + np.log(own)).sum(axis=1)
    out -= (0.5 * (pair / both) ** 2 + np.log(both)).sum(axis=(1, 2))
    return out - log_drawn


def tail_index(log_weights: np.ndarray) -> float:
    """Hill's index of the largest weights: below 0.5 their variance is finite, above 0.7 they are
    not to be trusted. The largest fifth of them counts, at most three times the root of all."""
    n = len(log_weights)
    many = int(min(n / 5, 3 * n**0.5))
    if many < 2:
        return float("nan")
    top = np.sort(log_weights)[-many - 1 :]
    return float((top[1:] - top[0]).mean())
