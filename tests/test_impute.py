import numpy as np
import pytest

from seasoncast.operators import impute
from seasoncast.operators.impute import knn_impute, least_distances


def brute_force(x, k=2):
    n, months = x.shape
    out = x.copy()
    for i in range(n):
        for m in np.flatnonzero(np.isnan(x[i])):
            near = []
            for j in range(n):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if not np.isnan(x[j, m]) and both.any():
                    d = (x[i] - x[j])[both]
                    near.append((months / both.sum() * (d * d).sum(), x[j, m]))
            near.sort()
            out[i, m] = np.mean([y for _, y in near[:k]]) if near else np.nanmean(x[:, m])
    return out


def wide(spark, panels):
    n = next(iter(panels.values())).shape[1]
    rows = [
        (p, f"s{i:03d}", "g", *[None if np.isnan(v) else float(v) for v in r])
        for p, x in panels.items()
        for i, r in enumerate(x)
    ]
    cells = ", ".join(f"`{m}` double" for m in range(n))
    return spark.createDataFrame(rows, f"panel string, season string, geography string, {cells}")


@pytest.mark.parametrize("tile_rows", [1024, 16])
def test_equals_brute_force(spark, tile_rows):
    rng = np.random.default_rng(1)
    panels = {}
    for name in ("p", "q"):
        x = np.cumsum(rng.random((120, 6)) * 0.1, axis=1).round(2)
        x[rng.random(x.shape) < 0.15] = np.nan
        x[0], x[1, :5] = np.nan, np.nan
        # Copies of one row, a third of the panel.
        x[40:80] = x[40]
        panels[name] = x
    out = knn_impute(wide(spark, panels), range(6), ["panel"], tile_rows=tile_rows)
    for name, x in panels.items():
        rows = out.filter(out.panel == name).orderBy("season").collect()
        got = np.array([r[3:] for r in rows], dtype=float)
        np.testing.assert_allclose(got, brute_force(x), atol=1e-12)
        assert (got[~np.isnan(x)] == x[~np.isnan(x)]).all()


def test_a_column_without_values_raises(spark):
    x = np.array([[0.1, np.nan], [0.2, np.nan]])
    with pytest.raises(Exception, match="has no value"):
        knn_impute(wide(spark, {"p": x}), range(2), ["panel"]).collect()


def test_bounds_hold_for_every_row_of_a_tile():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, y = rng.random((7, 5)), rng.random((9, 5)) + rng.random()
        x[rng.random(x.shape) < 0.3], y[rng.random(y.shape) < 0.4] = np.nan, np.nan
        there = ~np.isnan(y)
        low = np.where(there, y, np.inf).min(axis=0)
        high = np.where(there, y, -np.inf).max(axis=0)
        bound = least_distances(x, low, high, np.unique(there @ (1 << np.arange(5))))
        for i, row in enumerate(x):
            reach = []
            for other in y:
                d = row - other
                both = ~np.isnan(d)
                if both.any():
                    reach.append(5 / both.sum() * (d[both] ** 2).sum())
            assert bound[i] <= (min(reach) + 1e-12 if reach else np.inf)
            assert np.isfinite(bound[i]) == bool(reach)


def test_months_with_no_one_or_two_donors(spark):
    """Cells of rare months look at their few donors, whatever the other cells of the row need."""
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.random((400, 6)), axis=1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 0], x[:, 5] = np.nan, np.nan
    x[7, 0] = 0.5
    x[[9, 300], 5] = 2.0, 5.0
    got = knn_impute(wide(spark, {"p": x}), range(6), ["panel"], tile_rows=32).orderBy("season")
    np.testing.assert_allclose(np.array([r[3:] for r in got.collect()], dtype=float), brute_force(x), atol=1e-12)


def test_without_panels_and_without_gaps(spark):
    x = np.round(np.random.default_rng(2).random((50, 3)), 1)
    full = wide(spark, {"p": x}).drop("panel")
    assert knn_impute(full, range(3)).count() == 50
    x[::3, 1] = np.nan
    rows = knn_impute(wide(spark, {"p": x}).drop("panel"), range(3), tile_rows=8).orderBy("season").collect()
    np.testing.assert_allclose(np.array([r[2:] for r in rows], dtype=float), brute_force(x), atol=1e-12)


def curves(n):
    """Rows of a panel: curves of different height and time, months with one donor and two, one value
    in half of the rows, gaps at random."""
    rng = np.random.default_rng(n)
    height, middle = rng.random((n, 1)), 2 + 3 * rng.random((n, 1))
    x = height / (1 + np.exp(middle - np.arange(8))) + 1e-4 * rng.standard_normal((n, 8))
    x[: n // 2, 3] = 0.25
    gaps = rng.random(x.shape) < 0.1
    gaps[:, 1] = rng.random(n) < 0.5
    x[gaps] = np.nan
    x[:, 6], x[:, 7] = np.nan, np.nan
    x[n // 3, 6] = 1.0
    x[[n // 4, n // 5], 7] = 1.0, 2.0
    return x


def test_opened_tiles_grow_with_the_rows(spark, monkeypatch):
    """Pairs of rows that are compared, for each row: nearly the same on ten times the rows."""
    evaluated, compared = impute._evaluated, []

    def counting(seeking, opened, tiles, n):
        rows = {r["_id"]: (r["_v"], r["_r"]) for r in seeking.collect()}
        held = {r["_tile"]: np.array(r["_y"]).reshape(-1, n) for r in tiles.collect()}
        by_tile = {}
        for r in opened.collect():
            by_tile.setdefault(r["tile"], []).append(rows[r["_id"]])
        pairs = 0
        for tile, own in by_tile.items():
            x, reach = np.array([v for v, _ in own]), np.array([r for _, r in own])
            pairs += sum(len(a) * len(b) for a, b in impute.within_reach(x, reach, held[tile]))
        compared.append(pairs)
        return evaluated(seeking, opened, tiles, n)

    monkeypatch.setattr(impute, "_evaluated", counting)
    share = []
    for n in (2_000, 20_000):
        out = knn_impute(wide(spark, {"p": curves(n)}), range(8), ["panel"], tile_rows=150)
        assert out.count() == n
        share.append(sum(compared) / n)
        compared.clear()
    assert share[1] < 2 * share[0] and share[1] < 1_000
