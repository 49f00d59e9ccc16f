"""Exact search against all products, approximate search by its recall."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seasoncast.llm import nn_descent, va_search

SCHEMA = "vec_id int, embedding array<double>, score string"


def odd_rows():
    draw = np.random.default_rng(3)
    points = draw.normal(size=(260, 6))
    points[40:90] = points[0]  # a common vector
    points[100:130] = np.round(points[100:130])  # ties
    rows = [(i, p.tolist(), "x") for i, p in enumerate(points)]
    rows += [
        (5, points[5].tolist(), "x"),  # a repeated row
        (900, None, "x"),
        (901, [], "x"),
        (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"),
        (903, [float("nan")] * 6, "x"),
        (904, [float("inf")] + [0.0] * 5, "x"),
        (905, [0.0] * 6, "x"),
        (906, [1.0, 2.0], "x"),
        (None, [1.0] * 6, "x"),
    ]
    return rows


def six(rows):
    good = {
        i: v
        for i, v, _ in rows
        if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all()
    }
    return good


def test_va_search_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(va_search, "BLOCK_VECTORS", 64)
    monkeypatch.setattr(va_search, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(va_search, "FIRST_READ", 6)
    rows = odd_rows()
    table = spark.createDataFrame(rows, SCHEMA)
    got = va_search.search(table, F.col("id") % 10 == 0, 5).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v in six(rows).items()}
    for q in [i for i in ints if i % 10 == 0]:
        scores = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        assert sorted(found.pop(q)) == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert not found


@pytest.mark.parametrize("size", [2.0e6, 2.0**31, 2.0**40])
def test_va_search_is_exact_on_large_components(spark, size):
    """Scores that fit a long are exact, however large the components."""
    draw = np.random.default_rng(8)
    points = draw.normal(size=(40, 64))
    points[3], points[5] = 0.0, 0.0
    points[3, 0], points[5, 1] = size, size
    if size < 1e7:
        points[8, 0], points[16, 0] = 2.5e6, 3.0e6  # products of two large components
    table = spark.createDataFrame([(i, p.tolist(), "") for i, p in enumerate(points)], SCHEMA)
    got = {}
    for r in va_search.search(table, F.col("id") % 8 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [[int(np.floor(256 * x)) for x in p] for p in points]
    for q in range(0, 40, 8):
        scores = [
            (-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in enumerate(whole) if i != q
        ]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5], 1)]


def test_va_search_beyond_a_long(spark):
    """Huge candidates that lose are no matter; a listed score that is no long raises."""
    rows = [(0, [1.0, 1.0], ""), (1, [2.0, 2.0], ""), (2, [-1e300, 1.0], ""), (3, [1e300, -1e300], "")]
    table = spark.createDataFrame(rows, SCHEMA)
    got = va_search.search(table, F.col("id") == 0, 2).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 2 * 256 * 512), (2, 3, 0)]
    with pytest.raises(Exception, match="does not fit 64 bits"):
        va_search.search(table, F.col("id") == 0, 3).collect()
    with pytest.raises(Exception, match="not finite"):
        bad = spark.createDataFrame([(0, [1e307, 0.0], ""), (1, [1.0, 0.0], "")], SCHEMA)
        va_search.search(bad, F.col("id") == 0, 1).collect()


def test_nn_descent_finds_nearly_all(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = nn_descent.search(rows, F.col("id") % 20 == 0, 10).collect()
    pdf = rows.toPandas()
    points, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    place = {int(i): n for n, i in enumerate(ids)}
    hits = 0
    for q in ids[ids % 20 == 0]:
        far = np.sqrt(((points - points[place[q]]) ** 2).sum(axis=1))
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [n for n, _, _ in own] == list(range(1, 11))
        assert np.allclose([s for *_, s in own], [far[place[v]] for _, v, _ in own], rtol=1e-12)
        near = [i for i in ids[np.lexsort((ids, far))] if i != q][:10]
        hits += len({v for _, v, _ in own} & set(near))
    assert hits >= 0.9 * len(got)


@pytest.mark.parametrize(
    "n_rows,step,least",
    [
        (5_000, 100, 0.97),
        # Minutes; run with LARGE_TESTS=1.
        *([(10_000, 100, 0.97), (50_000, 1_000, 0.95)] if os.environ.get("LARGE_TESTS") else []),
    ],
)
def test_recall_of_nn_descent(spark, n_rows, step, least):
    """Random unit vectors of 64 components, for which near and far hardly differ."""
    points = np.random.default_rng(n_rows).normal(size=(n_rows, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    frame = pd.DataFrame({"vec_id": np.arange(n_rows), "embedding": points.tolist()})
    got = nn_descent.search(spark.createDataFrame(frame), F.col("id") % step == 0, 10).collect()
    hits = 0
    for n in range(0, n_rows, step):
        far = ((points - points[n]) ** 2).sum(axis=1)
        near = [i for i in np.argsort(far, kind="stable")[:11] if i != n][:10]
        hits += len({r["vec_id"] for r in got if r["query_id"] == n} & set(near))
    assert len(got) == 10 * (n_rows // step)
    assert hits >= least * len(got)


def test_beam_grows_with_the_doublings():
    assert nn_descent.beam_for(0) == nn_descent.beam_for(1) == 8
    assert nn_descent.beam_for(50_000) == 8 * 16 and nn_descent.beam_for(10**9) == 8 * 30


def test_nn_descent_beside_one_huge_vector(spark):
    points = np.random.default_rng(5).normal(size=(300, 4))
    points[0] = [1e9, -1e9, 1e9, 1e9]
    table = spark.createDataFrame([(i, p.tolist(), "") for i, p in enumerate(points)], SCHEMA)
    vectors = table.select(F.col("vec_id").cast("long").alias("rep"), F.col("embedding").alias("vec"))
    got = nn_descent.neighbour_graph(vectors, 8).collect()
    hits = 0
    for i in range(1, 300):
        far = ((points - points[i]) ** 2).sum(axis=1)
        hits += len({r["v"] for r in got if r["u"] == i} & set(np.argsort(far)[1:9].tolist()))
    assert hits >= 0.95 * 8 * 299


def test_nn_descent_on_odd_rows(spark):
    rows = odd_rows()
    got = nn_descent.search(spark.createDataFrame(rows, SCHEMA), F.col("id") == 41, 10).collect()
    # Copies of the query come first, by id.
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (i, 0.0) for i in [0, 40, *range(42, 50)]
    ]


@pytest.mark.parametrize("module", [nn_descent, va_search])
def test_few_and_no_rows(spark, module):
    table = spark.createDataFrame([(1, [1.0, 0.0], ""), (2, [0.5, 1.0], "")], SCHEMA)
    got = module.search(table, F.col("id") == 1, 5).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(1, 1, 2)]
    assert module.search(table.limit(0), F.col("id") == 1, 5).count() == 0
