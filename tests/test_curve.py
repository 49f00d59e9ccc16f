import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasoncast.config import SeasonConfig
from seasoncast.functions import curve
from seasoncast.functions.quantile import interpolated
from seasoncast.models import CurveModel, curve_fit, curve_predict
from seasoncast.models import curve_math as cm
from seasoncast.models.curve_math import natural

PRIOR = {
    "seed": 42, "muA_shape1": 100.0, "muA_shape2": 180.0, "sigmaA_rate": 80.0,
    "tau_shape1": 100.0, "tau_shape2": 225.0, "K_shape": 150.0, "K_rate": 6.0,
    "muM_shape": 2.0, "muM_rate": 25.0, "sigmaM_rate": 80.0, "D_shape": 1000.0, "D_rate": 3.0,
    "num_samples": 200, "num_chains": 4,
}


def test_gamma_functions(spark):
    z = [1e-4, 0.03, 0.5, 1.0, 3.7, 40.0, 1e3, 1e6]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    rows = df.select(
        "z",
        curve.lgamma(F.col("z")).alias("g"),
        curve.digamma(F.col("z")).alias("d"),
        curve.trigamma(F.col("z")).alias("t"),
    ).collect()
    for r in rows:
        assert r.g == pytest.approx(math.lgamma(r.z), rel=1e-11, abs=1e-12)
        # Recurrences tie the derivatives to exact values.
        h = 1e-5 * r.z
        assert r.d == pytest.approx((math.lgamma(r.z + h) - math.lgamma(r.z - h)) / (2 * h), rel=1e-4, abs=1e-4)
        assert r.t > 0
    one = df.select(curve.digamma(F.lit(1.0)), curve.trigamma(F.lit(1.0))).first()
    assert one[0] == pytest.approx(-0.57721566490153286, abs=1e-11)
    assert one[1] == pytest.approx(math.pi**2 / 6, abs=1e-10)


def test_loglik_sums_to_one_and_edges(spark):
    df = spark.range(21).withColumn("x", F.col("id").cast("double"))
    p = df.select(F.exp(curve.betabinom_logpmf(F.col("x"), F.lit(20.0), F.lit(0.3), F.lit(9.0))).alias("p"))
    assert p.agg(F.sum("p")).first()[0] == pytest.approx(1.0, abs=1e-10)
    empty = spark.range(1).select(
        curve.betabinom_logpmf(F.lit(0.0), F.lit(0.0), F.lit(1e-6), F.lit(300.0))
    )
    assert empty.first()[0] == pytest.approx(0.0, abs=1e-9)


def test_curve_is_not_clamped(spark):
    def at(A, M, t):
        return spark.range(1).select(
            curve.lpl_curve(*[F.lit(float(v)) for v in (A, M, 25, 0.3, t)])
        ).first()[0]

    assert at(0.4, 0, 0.3) == pytest.approx(0.2)
    assert at(0, 0.1, 1) == pytest.approx(0.1)
    assert at(0, -0.5, 1) == pytest.approx(-0.5)
    assert at(0.9, 0.9, 1) > 1


def test_interpolated_quantile(spark):
    values = [3.0, 1.0, 7.0, 9.0]
    df = spark.createDataFrame([(sorted(values),)], "v array<double>")
    for q in (0.0, 0.025, 0.5, 0.975, 1.0):
        assert df.select(interpolated(F.col("v"), q)).first()[0] == pytest.approx(np.quantile(values, q))


def test_group_sums_are_derivatives(spark):
    rows = [(m / 12, float(x), 800.0, 1.0) for m, x in enumerate([0, 1, 10, 150, 260, 280, 300, 310])]
    obs = spark.createDataFrame(
        [("d", "g", 0, 0, 1, *r) for r in rows],
        "forecast_date string, geography string, s int, chunk int, chunks int, "
        "t double, x double, n double, w double",
    )
    at = np.array([0.36, 0.08, 25.0, 0.31])
    state = spark.createDataFrame(
        [("d", 0, "g", 0, 1, 0.0, 0.0, 0.0, 0.0, *at.tolist(), 333.0)],
        "forecast_date string, shard int, geography string, s int, chunks int, geo_A double, "
        "geo_M double, pair_A double, pair_M double, A double, M double, K double, tau double, D double",
    )
    got = curve_fit._group_sums(state, obs, ["forecast_date"], curve_fit._row_expressions()).first()

    def loglik(p, D=333.0):
        total = 0.0
        for t, x, n, _ in rows:
            v = p[0] / (1 + math.exp(-p[2] * (t - p[3]))) + p[1] * t
            a, b = v * D, (1 - v) * D
            total += math.lgamma(x + a) - math.lgamma(a) + math.lgamma(n - x + b)
            total += math.lgamma(D) - math.lgamma(b) - math.lgamma(n + D)
        return total

    assert got["loglik"] == pytest.approx(loglik(at), abs=1e-6)
    for i, name in enumerate(("g_A", "g_M", "g_K", "g_T")):
        h = np.zeros(4)
        h[i] = 1e-5 * at[i]
        assert got[name] == pytest.approx((loglik(at + h) - loglik(at - h)) / (2 * h[i]), rel=1e-4)
    assert got["d_score"] == pytest.approx((loglik(at, 333.1) - loglik(at, 332.9)) / 0.2, rel=1e-4)


def simulated(spark, panels, seed=0, n_seasons=6, n_geo=5):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(panels):
        mu_a, mu_m, tau = rng.beta(100, 180), rng.gamma(2, 1 / 25), rng.beta(100, 225)
        K, D = rng.gamma(150, 1 / 6), rng.gamma(1000, 1 / 3)
        scales = rng.exponential(1 / 80, (3, 2))
        by_s, by_g, by_sg = (
            rng.standard_normal((*shape, 2)) * scales[j]
            for j, shape in enumerate([(n_seasons,), (n_geo,), (n_seasons, n_geo)])
        )
        for s in range(n_seasons):
            for g in range(n_geo):
                A, M = np.array([mu_a, mu_m]) + by_s[s] + by_g[g] + by_sg[s, g]
                for m in range(10):
                    day = dt.date(2010 + s + (m > 5), (m + 6) % 12 + 1, 1)
                    t = (day - dt.date(2010 + s, 7, 1)).days / 365
                    v = float(np.clip(A / (1 + np.exp(-K * (t - tau))) + max(M, 1e-3) * t, 1e-6, 1))
                    x = rng.binomial(800, rng.beta(v * D, (1 - v) * D))
                    rows.append((f"p{p}", f"g{g}", day, x / 800, 800, f"{2010 + s}/{2011 + s}", v))
    return spark.createDataFrame(
        rows,
        "panel string, geography string, time_end date, estimate double, N_tot int, "
        "season string, v double",
    )


def model(data, dates):
    return CurveModel(
        data=data,
        forecast_dates=dates,
        params=PRIOR,
        season=SeasonConfig(7, 4),
        quantiles=[0.5, 0.025, 0.975],
        group_cols=["panel"],
    )


def test_fit_covers_the_true_curve(spark, tmp_path):
    data = simulated(spark, panels=4)
    fitted = model(data, [dt.date(2015, 10, 1), dt.date(2015, 12, 1)]).fit()
    fits = fitted.fits.collect()
    assert len(fits) == 8 and all(r["converged"] for r in fits)
    for r in fits:
        mu_a, mu_m, K, tau = natural(np.array(r["theta"]))
        assert 0.2 < mu_a < 0.55 and mu_m > 0 and 15 < K < 40 and 0.2 < tau < 0.45
    preds = fitted.predict()
    wide = (
        preds.groupBy("panel", "forecast_date", "season", "geography", "time_end")
        .agg(*[F.max(F.when(F.col("quantile") == q, F.col("estimate"))).alias(n)
               for q, n in ((0.025, "low"), (0.5, "mid"), (0.975, "high"))])
        .join(data, ["panel", "season", "geography", "time_end"])
    )
    assert wide.count() == 2 * data.count()
    checks = wide.agg(
        F.bool_and((F.col("low") <= F.col("mid")) & (F.col("mid") <= F.col("high"))).alias("ordered"),
        F.avg(F.col("v").between(F.col("low"), F.col("high")).cast("int")).alias("covered"),
        F.avg(F.abs(F.col("mid") - F.col("v"))).alias("error"),
    ).first()
    assert checks["ordered"] and checks["covered"] > 0.88 and checks["error"] < 0.02
    assert fitted.summary().count() == 8 * 11

    # A loaded model repeats the numbers of the one that was saved.
    path = str(tmp_path / "curve")
    fitted.save(path)
    again = model(data, [dt.date(2015, 10, 1), dt.date(2015, 12, 1)]).load(spark, path).predict()
    keys = ["panel", "forecast_date", "season", "geography", "time_end", "quantile"]
    both = preds.join(again.withColumnRenamed("estimate", "again"), keys)
    assert both.agg(F.max(F.abs(F.col("estimate") - F.col("again")))).first()[0] < 1e-12


def test_hidden_cells_are_covered(spark):
    """Cells after the forecast date alone, on 30 panels that nothing was tuned on."""
    data = simulated(spark, panels=30, seed=2024)
    date = dt.date(2015, 11, 1)
    preds = model(data, [date]).fit().predict().filter(F.col("time_end") > F.lit(date))
    wide = preds.groupBy("panel", "season", "geography", "time_end").agg(
        *[F.max(F.when(F.col("quantile") == q, F.col("estimate"))).alias(n)
          for q, n in ((0.025, "low"), (0.975, "high"))]
    ).join(data, ["panel", "season", "geography", "time_end"])
    checks = wide.agg(
        F.count("*").alias("cells"),
        F.avg(F.col("v").between(F.col("low"), F.col("high")).cast("int")).alias("covered"),
        F.avg(F.col("high") - F.col("low")).alias("width"),
    ).first()
    assert checks["cells"] == 30 * 5 * 5
    assert checks["covered"] >= 0.93 and checks["width"] < 0.2


def exact_scales(sums, at, prior, grid):
    """Log evidence of scales by one dense normal integral over all effects and parameters."""
    score, info, geo, pair = sums
    n_geo, n_seasons = score.shape[:2]
    p = 4 + 2 * n_seasons
    size = p + 2 * n_geo + 2 * n_geo * n_seasons
    slope = np.ones(size)
    slope[:p] = cm.slope_of_natural(at)
    grad, hess = np.zeros(size), np.zeros((size, size))
    for b in range(n_geo):
        for s in range(n_seasons):
            J = np.zeros((4, size))
            J[:4, :4] = np.eye(4)
            for i in (0, 1):
                J[i, 4 + i * n_seasons + s] = 1
                J[i, p + 2 * b + i] = 1
                J[i, p + 2 * n_geo + 2 * (b * n_seasons + s) + i] = 1
            grad += J.T @ score[b, s]
            hess += J.T @ info[b, s] @ J
    grad, hess = grad * slope, hess * np.outer(slope, slope)
    mu_a, mu_m, K, tau = cm.natural(at)
    for i, v, name in ((0, mu_a, "muA"), (3, tau, "tau")):
        one, two = prior[f"{name}_shape1"], prior[f"{name}_shape2"]
        grad[i] += one - (one + two) * v
        hess[i, i] += (one + two) * v * (1 - v)
    for i, v, name in ((1, mu_m, "muM"), (2, K, "K")):
        grad[i] += prior[f"{name}_shape"] - prior[f"{name}_rate"] * v
        hess[i, i] += prior[f"{name}_rate"] * v
    effects = np.concatenate([at[4:], geo.ravel(), pair.ravel()])
    out = []
    for sigma in grid:
        spread = np.concatenate(
            [np.repeat(sigma[[0, 3]], n_seasons), np.tile(sigma[[1, 4]], n_geo), np.tile(sigma[[2, 5]], n_geo * n_seasons)]
        )
        g, h = grad.copy(), hess.copy()
        g[4:] -= effects / spread**2
        h[4:, 4:] += np.diag(spread**-2.0)
        value = 0.5 * (g @ np.linalg.solve(h, g) - np.linalg.slogdet(h)[1])
        value -= (np.log(spread) + 0.5 * (effects / spread) ** 2).sum()
        out.append(value + (np.log(sigma) - cm.scale_rates(prior) * sigma).sum())
    return np.array(out)


def test_evidence_of_scales_equals_one_dense_integral():
    rng = np.random.default_rng(1)
    n_geo, n_seasons = 3, 4
    roots = rng.normal(size=(n_geo, n_seasons, 4, 4)) * 30
    info = roots @ roots.transpose(0, 1, 3, 2)
    info[1, 2] = 0  # a pair without rows
    score = rng.normal(size=(n_geo, n_seasons, 4)) * 40
    score[1, 2] = 0
    geo, pair = rng.normal(size=(n_geo, 2)) * 0.01, rng.normal(size=(n_geo, n_seasons, 2)) * 0.01
    at = np.concatenate([[-0.6, -2.5, 3.2, -0.8], rng.normal(size=2 * n_seasons) * 0.01])
    grid = np.exp(rng.normal(size=(5, 6))) / 80
    want = exact_scales((score, info, geo, pair), at, PRIOR, grid)
    got = []
    for sigma in grid:
        local = cm.eliminate(score, info, geo, pair, sigma)
        shared = cm.scale_evidence(at, local.score, local.information, sigma, PRIOR)
        got.append(local.evidence + shared)
    # Equal up to a constant.
    assert np.diff(got) == pytest.approx(np.diff(want), rel=1e-7, abs=1e-7)


def test_scale_points_and_shares():
    sigma, effective = np.full(6, 0.02), np.array([4.0, 3.0, 20.0, 0.0, 0.0, 0.0])
    points, proposed = cm.scale_points(sigma, effective, PRIOR, 8, np.random.default_rng(0))
    assert points.shape == (8, 6) and np.allclose(points[:4] * points[4:], sigma**2)
    assert proposed == pytest.approx(np.tile(proposed[:4], 2))
    assert cm.shares_of_draws(np.array([0.5, 0.0, 0.25, 0.25]), 100).tolist() == [50, 0, 25, 25]
    assert cm.shares_of_draws(np.array([1e-9, 1.0]), 7).tolist() == [0, 7]


def test_summary_and_effects(spark):
    data = simulated(spark, panels=1, seed=9).withColumn(
        "geography", F.when(F.col("geography") != "g4", F.col("geography"))
    )
    fitted = model(data, [dt.date(2015, 12, 1)]).fit()
    summary = {r.parameter: r for r in fitted.summary().collect()}
    assert set(summary) == {
        "muA", "muM", "K", "tau", "D",
        *(f"sigma{p}_{f}" for p in "AM" for f in ("season", "geography", "season_geo")),
    }
    assert all(r["q05"] < r["median"] < r["q95"] and r["std"] > 0 for r in summary.values())
    assert 1 <= summary["D"]["effective_points"] <= 32
    effects = fitted.effects().collect()
    count = {f: sum(r.feature == f for r in effects) for f in ("season", "geography", "season_geo")}
    # A null geography is a geography.
    assert count == {"season": 12, "geography": 10, "season_geo": 60}
    assert sum(r.geography is None for r in effects if r.feature == "geography") == 2
    assert fitted.predict().filter("geography IS NULL").count() == 60 * 3


def test_weights_are_posterior_over_proposal(spark):
    """Against a direct evaluation of both densities for one geography and two seasons."""
    data = simulated(spark, panels=1, seed=4, n_seasons=2, n_geo=1)
    date = dt.date(2011, 12, 1)
    fitted = model(data, [date]).fit()
    got = sorted(fitted.weights(40).collect(), key=lambda r: r.draw)
    assert [r.draw for r in got] == list(range(40))
    points = sorted(fitted.design.collect(), key=lambda r: r.point)
    known = curve_predict._points_and_groups(fitted.design, fitted.groups, ["panel", "forecast_date", "shard"]).toPandas()
    keys = ["panel", "forecast_date"]
    drawn, place = curve_predict._drawn_points(known, np.array(["g0"]), keys, 40, fitted.seed)
    evidence = {tuple(p.sigma): p.evidence for p in points}
    covs = {tuple(p.sigma): np.array(p["cov"]).reshape(8, 8) for p in points}
    D = fitted.fits.first()["D"]
    rows = [r for r in fitted.rows.collect() if r.time_end <= date]
    rng = curve_predict.generator(fitted.seed, "p0", date, "g0")
    want, valid = [], []
    for d in drawn:
        geo, pair, _ = cm.draw_effects(d.local, 0, d.theta, d.thetas, rng)
        for i, theta in enumerate(d.thetas):
            own = cm.on_own_scale(theta)
            g, p = d.geo[0] + geo[i], d.pair[0] + pair[i]
            value, lowest = cm.log_prior(theta, d.sigma, 1.0, PRIOR) + PRIOR["D_rate"], 1.0
            value += np.log(cm.slope_of_natural(theta)[:4]).sum() + np.log(d.sigma).sum()
            value -= np.sum(0.5 * (g / d.sigma[[1, 4]]) ** 2 + np.log(d.sigma[[1, 4]]))
            value -= np.sum(0.5 * (p / d.sigma[[2, 5]]) ** 2 + np.log(d.sigma[[2, 5]]))
            for r in rows:
                s = int(r.season[:4]) - 2010
                A, M = (own[j] + own[4 + 2 * j + s] + g[j] + p[s, j] for j in (0, 1))
                v = A / (1 + math.exp(-own[2] * (r.t - own[3]))) + M * r.t
                lowest = min(lowest, v)
                a, b = max(v, 1e-6) * D, (1 - max(v, 1e-6)) * D
                value += math.lgamma(r.N_vax + a) - math.lgamma(a) + math.lgamma(D) - math.lgamma(b)
                value += math.lgamma(r.N_tot - r.N_vax + b) - math.lgamma(r.N_tot + D)
            # Densities of the draw: shared parameters, then effects given them.
            gap = theta - d.theta
            cov = covs[tuple(d.sigma)]
            value += 0.5 * gap @ np.linalg.solve(cov, gap) + 0.5 * np.linalg.slogdet(cov)[1]
            shift = own - cm.on_own_scale(d.theta)
            dev = geo[i] + d.local.geo_slope[0] @ shift
            value += 0.5 * dev @ np.linalg.solve(d.local.geo_cov[0], dev)
            value += 0.5 * np.linalg.slogdet(d.local.geo_cov[0])[1]
            for s in (0, 1):
                group = cm.season_design(2)[s] @ shift
                group[:2] += geo[i]
                dev = pair[i, s] + d.local.pair_slope[0, s] @ group
                value += 0.5 * dev @ np.linalg.solve(d.local.pair_cov[0, s], dev)
                value += 0.5 * np.linalg.slogdet(d.local.pair_cov[0, s])[1]
            want.append(value - evidence[tuple(d.sigma)])
            valid.append(lowest > 1e-4)
    # Equal up to a constant wherever the curve stays above 0.
    gap = (np.array([r.log_weight for r in got]) - want)[valid]
    assert sum(valid) > 20 and np.ptp(gap) < 1e-5


def test_tail_index_tells_heavy_tails():
    rng = np.random.default_rng(0)
    for shape in (0.3, 0.9):
        heavy = shape * rng.exponential(size=4000)  # logs of Pareto weights
        assert cm.tail_index(heavy) == pytest.approx(shape, rel=0.25)
    assert cm.tail_index(np.zeros(100)) == 0.0 and math.isnan(cm.tail_index(np.zeros(3)))


def test_a_skewed_posterior_shows_in_the_weights(spark):
    """Few people asked: the curve may be near 0 or below, where the posterior is far from normal."""
    good = simulated(spark, panels=1, seed=5)
    poor = good.withColumns({"N_tot": F.lit(12), "panel": F.lit("poor")})
    fitted = model(good.unionByName(poor), [dt.date(2015, 12, 1)]).fit()
    found = {r.panel: r for r in fitted.summary().filter("parameter = 'muA'").collect()}
    assert found["poor"]["tail_index"] > 0 and found["p0"]["tail_index"] > 0
    assert 1 <= found["poor"]["effective_draws"] <= 200 and 1 <= found["p0"]["effective_draws"] <= 200


def test_a_fit_settles_on_many_observations_against_the_curve(spark):
    # Shares that grow steadily, alike everywhere: no bend, and hardly any effects.
    rng = np.random.default_rng(0)
    rows = []
    for s in range(3):
        for g in range(5):
            n = rng.poisson(5000, 10)
            share = np.cumsum(rng.binomial(n, 1 / 3)) / n.sum()
            for m in range(10):
                day = dt.date(2010 + s + (m > 5), (m + 6) % 12 + 1, 1)
                rows.append(("p", f"g{g}", day, float(share[m]), int(n[m]), f"{2010 + s}/{2011 + s}"))
    data = spark.createDataFrame(
        rows,
        "panel string, geography string, time_end date, estimate double, N_tot int, season string",
    )
    curves = model(data, [dt.date(2013, 4, 1)])
    fits, _ = curve_fit.fit_curves(
        curves.rows, curves.forecast_dates, curves.seasons, curves.prior, ["panel"], max_passes=30
    )
    fit = fits.first()
    assert fit["converged"]
    assert max(np.abs(fit["pull"])) < 0.03


def test_damping_ends_an_overshoot():
    # Whole steps overshoot in the first direction, by a little more each time.
    bend, cov = np.array([2.1, 1.0, 0.9]), np.diag([1.0, 4.0, 0.25])
    x = np.array([1.0, 1.0, 1.0])
    last, part = np.zeros(3), 1.0
    for _ in range(12):
        step = -bend * x
        part = cm.damping(step, last, part, cov)
        x, last = x + part * step, step
    assert np.abs(x).max() < 1e-3


def test_scales_reach_their_mode():
    # 25 effects seen with variance v; the mode solves one equation, known or hardly known.
    for squares, v in ((25 * 4e-4, 1e-6), (25e-8, 1e-7), (25e-6, 1e-2)):
        sigma, pull, drift = 0.0125, 0.0, 0.0
        for _ in range(25):
            kept = sigma**2 / (sigma**2 + v)
            last, pull = pull, cm.scale_pull(squares * kept**2, 25 * kept, sigma, 80.0)
            slope = cm.secant_slope(*np.array([[pull], [last], [drift]]))[0]
            drift = float(np.clip(pull / slope, -0.4, 0.4))
            sigma *= np.exp(drift)
        assert abs(pull) < 1e-3
