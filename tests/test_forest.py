import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasoncast.config import SeasonConfig
from seasoncast.models import ForestModel, trees


@pytest.fixture(scope="module")
def frame(spark):
    # The six-row case.
    dates = [dt.date(y, m, 1) for y in (2018, 2019) for m in (9, 10, 11)]
    rows = [
        ("USA", d, float(e), 1000, "2018/2019" if d.year == 2018 else "2019/2020")
        for d, e in zip(dates, np.linspace(1e-4, 5e-4, 6))
    ]
    return spark.createDataFrame(
        rows, "geography string, time_end date, estimate double, sample_size int, season string"
    )


def forest(frame, dates=(dt.date(2019, 10, 1),)):
    return ForestModel(
        data=frame,
        season=SeasonConfig(9, 4),
        params={"n_estimators": 10},
        forecast_dates=dates,
        quantiles=[0.025, 0.5, 0.975],
    )


def test_one_training_season(spark, frame, tmp_path):
    fitted = forest(frame).fit()
    pred = fitted.predict()
    assert set(pred.columns) == {
        "season", "geography", "time_end", "forecast_date", "quantile", "estimate"
    }
    rows = pred.collect()
    assert {r.quantile for r in rows} == {0.025, 0.5, 0.975} and len(rows) == 3
    assert all(r.time_end == dt.date(2019, 11, 1) for r in rows)
    assert all(r.estimate == pytest.approx(2.6e-4) for r in rows)
    fitted.save(str(tmp_path / "forest"))
    again = forest(frame).load(spark, str(tmp_path / "forest")).predict().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_cutoffs_and_checks(frame):
    assert forest(frame).cutoffs()[dt.date(2019, 10, 1)] == ("2019/2020", 1)
    with pytest.raises(AssertionError):
        forest(frame, [dt.date(2019, 6, 1)]).cutoffs()
    with pytest.raises(AssertionError):
        forest(frame).predict()
    with pytest.raises(ValueError):
        ForestModel(
            data=frame, season=SeasonConfig(9, 4, start_day=2), params={}, forecast_dates=[], quantiles=[]
        )


SEASONS = [f"{y}/{y + 1}" for y in range(2010, 2016)]


def panel_rows(seed, geographies=5, n_months=6, levels=None):
    """A complete panel; ``levels`` limits the different values."""
    rng = np.random.default_rng(seed)
    rows = []
    for s, season in enumerate(SEASONS):
        for g in range(geographies):
            steps = np.cumsum(rng.random(n_months)) + g / 3 + s / 7
            for m in range(n_months):
                value = float(np.round(steps[m] * levels) / levels if levels else steps[m])
                rows.append((season, f"g{g}", dt.date(2010 + s, 7 + m, 1), value))
    return rows


SCHEMA = "season string, geography string, time_end date, estimate double"


def model(data, params, dates=(dt.date(2015, 9, 1),), quantiles=(0.5,), group_cols=()):
    return ForestModel(
        data=data, season=SeasonConfig(7, 4), params=params, forecast_dates=dates,
        quantiles=quantiles, group_cols=group_cols,
    )


class Exhaustive:
    """A tree that tries every test on every node, in plain numpy."""

    def __init__(self, x_labels, x_numbers, y, w, max_depth=None):
        self.labels, self.numbers, self.y, self.w, self.max_depth = x_labels, x_numbers, y, w, max_depth
        self.root = self.build(np.flatnonzero(w > 0), 0)

    def error(self, at):
        w, y = self.w[at, None], self.y[at]
        return float((w * y**2).sum() - (((w * y).sum(axis=0)) ** 2).sum() / w.sum())

    def tests(self, at):
        for f, column in enumerate(self.labels):
            for label in sorted(set(column[at])):
                yield (f, label, 0.0), column == label
        for f, column in enumerate(self.numbers):
            values = sorted(set(column[at]))
            for low, high in itertools.pairwise(values):
                middle = (low + high) / 2
                yield (len(self.labels) + f, "", middle), column > middle

    def build(self, at, depth):
        mean = (self.w[at, None] * self.y[at]).sum(axis=0) / self.w[at].sum()
        whole = self.error(at)
        square = (self.w[at, None] * self.y[at] ** 2).sum()
        if whole <= 1e-12 * square or self.w[at].sum() < 2 or depth == self.max_depth:
            return mean
        best = None
        for name, passes in self.tests(at):
            one, two = at[passes[at]], at[~passes[at]]
            if len(one) and len(two):
                loss = -round((whole - self.error(one) - self.error(two)) / whole, 9)
                if best is None or (loss, name) < best[0]:
                    best = (loss, name), one, two
        if best is None:
            return mean
        return best[0][1], self.build(best[2], depth + 1), self.build(best[1], depth + 1)

    def predict(self, labels, numbers, node=None):
        node = self.root if node is None else node
        if isinstance(node, np.ndarray):
            return node
        (f, label, middle), other, passing = node
        own = [*labels, *numbers][f]
        passes = own == label if f < len(labels) else own > middle
        return self.predict(labels, numbers, passing if passes else other)


def by_hand(rows, weights, given=(0, 1, 2), targets=(3, 4, 5), max_depth=None):
    """Predictions of one exhaustive tree for the last season, by geography and target."""
    wide = {}
    for season, geography, date, value in rows:
        wide.setdefault((season, geography), {})[date.month - 7] = value
    past = sorted(k for k in wide if k[0] < SEASONS[-1])
    column = lambda m: np.array([wide[k][m] for k in past])
    labels = [np.array([k[0] for k in past]), np.array([k[1] for k in past])]
    tree = Exhaustive(
        labels, [column(m) for m in given], np.stack([column(m) for m in targets], axis=1), weights, max_depth
    )
    out = {}
    for (season, geography), values in wide.items():
        if season == SEASONS[-1]:
            found = tree.predict((season, geography), [values[m] for m in given])
            out |= {(geography, m): v for m, v in zip(targets, found)}
    return out


def forecasts(fitted, quantile=0.5):
    return {
        (r.geography, r.time_end.month - 7): r.estimate
        for r in fitted.predict().filter(F.col("quantile") == quantile).collect()
    }


@pytest.mark.parametrize("small", [0, 12, 4096])
@pytest.mark.parametrize("seed,levels,depth", [(1, None, None), (2, 4, 3)])
def test_a_tree_equals_exhaustive_search(spark, monkeypatch, seed, levels, depth, small):
    """Grown by levels, by levels and then in tasks, and in one task."""
    monkeypatch.setattr(trees, "SMALL_ROWS", small)
    rows = panel_rows(seed, levels=levels)
    fitted = model(
        spark.createDataFrame(rows, SCHEMA),
        {"n_estimators": 1, "bootstrap": False, "max_depth": depth},
    ).fit()
    want = by_hand(rows, np.ones(25), max_depth=depth)
    assert forecasts(fitted) == pytest.approx(want)


def test_every_tree_of_a_forest_equals_exhaustive_search(spark):
    """With the weights that each tree drew; quantiles stand on all of them."""
    rows = panel_rows(7)
    fitted = model(spark.createDataFrame(rows, SCHEMA), {"n_estimators": 9, "seed": 3}, quantiles=(0.25, 0.5)).fit()
    past = fitted._rows_of(past=True).withColumn("n", F.lit(25))
    drawn = trees.draw_samples(past, 9, 3).select("tree", "idx", "w").collect()
    assert fitted.nodes.select("tree").distinct().count() == 9
    weights = np.zeros((9, 25))
    for r in drawn:
        weights[r.tree, r.idx] = r.w
    assert (weights.sum(axis=1) == 25).all()
    single = [by_hand(rows, w) for w in weights]
    for q in (0.25, 0.5):
        got = forecasts(fitted, q)
        assert got == pytest.approx({k: np.quantile([s[k] for s in single], q) for k in got})
    assert len(got) == 15


def test_panels_and_cutoffs_grow_together_as_alone(spark):
    """Two panels and three dates in one job give what each panel and date gives alone."""
    schema = "panel string, " + SCHEMA
    rows = {p: [(p, *r) for r in panel_rows(s, geographies=3)] for p, s in (("x", 1), (None, 3))}
    dates = [dt.date(2015, 9, 1), dt.date(2014, 10, 1)]
    params = {"n_estimators": 1, "bootstrap": False, "max_depth": 2}
    both = model(spark.createDataFrame(sum(rows.values(), []), schema), params, dates, group_cols=["panel"]).fit()
    rounded = F.round("estimate", 9).alias("estimate")
    got = sorted(map(str, both.predict().withColumn("estimate", rounded).collect()))
    want = []
    for (panel, own), date in zip(rows.items(), dates):
        alone = model(spark.createDataFrame(own, schema), params, [date]).fit().predict()
        named = alone.withColumns({"panel": F.lit(panel), "estimate": rounded})
        named = named.select("panel", *alone.columns)
        want += map(str, named.collect())
    assert set(want) <= set(got) and len(got) == 2 * 3 * (3 + 2 * 2)


def test_bins_beyond_the_limit(spark):
    rows = panel_rows(5)
    frame = spark.createDataFrame(rows, SCHEMA)
    binned = model(frame, {"n_estimators": 1, "bootstrap": False, "max_bins": 4}).fit()
    keys = binned.features(dt.date(2015, 9, 1))
    for m in range(6):
        sizes = [r["count"] for r in keys.groupBy(f"k{m}").count().collect()]
        assert len(sizes) == 4 and max(sizes) <= 8 and sum(sizes) == 30
        assert keys.filter(f"m{m} > k{m}").isEmpty()
    lowest, highest = (f(e for *_, e in rows) for f in (min, max))
    assert all(lowest <= v <= highest for v in forecasts(binned).values())


def test_a_panel_without_training_rows_has_no_forecasts(spark):
    schema = "panel string, " + SCHEMA
    late = [("late", *r) for r in panel_rows(2) if r[0] >= SEASONS[-1]]
    data = spark.createDataFrame([("x", *r) for r in panel_rows(1)] + late, schema)
    got = model(data, {"n_estimators": 2}, group_cols=["panel"]).fit().predict()
    assert {r.panel for r in got.collect()} == {"x"}
    alone = spark.createDataFrame(late, schema)
    with pytest.raises(RuntimeError, match="no season before"):
        model(alone, {"n_estimators": 2}).fit()


def test_nothing_later_to_forecast(spark):
    data = spark.createDataFrame(panel_rows(1), SCHEMA)
    assert model(data, {"n_estimators": 2}, [dt.date(2015, 12, 1)]).fit().predict().count() == 0
