"""Hierarchical empirical Bayes against plain Python, and accuracy on labels that were held out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasoncast.llm.site_quality import Logistic, score_quality, site_posteriors

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fitted, held = (labels.filter(f"doc_id % 2 = {k}") for k in (0, 1))
    judged = score_quality(docs, fitted).join(held.select("doc_id", F.col("quality").alias("y")), "doc_id")
    rows = judged.select("kept", "y").collect()
    assert sum(r["kept"] == (r["y"] == 1) for r in rows) >= 0.99 * len(rows)
    good = [r for r in rows if r["y"] == 1]
    assert sum(r["kept"] for r in good) >= 0.995 * len(good)


def test_sites_shrink_toward_their_parents(spark):
    draw = np.random.default_rng(1)
    rows = []
    for host in range(30):
        mean = draw.beta(6, 2)
        for path in range(4):
            for _ in range(int(draw.integers(1, 40))):
                rows.append((f"h{host}", f"p{path}", float(draw.random() < mean)))
    scored = spark.createDataFrame(rows, "host string, path string, p double")
    sites, rate, among_hosts, among_paths = site_posteriors(scored)
    assert math.isclose(rate, np.mean([p for *_, p in rows]))
    # The spread of Beta(6, 2) is that of 8 pseudo-documents; all paths of a host are alike.
    assert 4 < among_hosts < 16 and among_paths > 20
    found = {(r["host"], r["path"]): r for r in sites.collect()}
    for (host, path), row in found.items():
        own = [p for h, q, p in rows if (h, q) == (host, path)]
        of_host = [p for h, _, p in rows if h == host]
        assert (row["n"], row["host_n"]) == (len(own), len(of_host))
        assert math.isclose(row["good"], sum(own)) and math.isclose(row["host_good"], sum(of_host))


def test_posterior_by_hand(spark):
    texts = ["good words in a row, and more of them."] * 30 + ["BAD$$$ $$$ $$$"] * 30
    rows = [(i, t, "s" if i % 3 else None, "en", "x") for i, t in enumerate(texts)]
    rows += [(100, None, "s", "en", "x"), (101, "", None, None, "x"), (102, "A$" * 50_000, "s", "en", "x")]
    rows += [rows[0]]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string, quality string")
    labels = spark.createDataFrame(
        [(i, int(i < 30)) for i in range(0, 60, 2)] + [(1, None), (3, 7), (None, 1)], "doc_id int, quality int"
    )
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["kept"] == (i < 30) for i in range(60)) and not by[102]["kept"]
    for r in got:
        odds = r["evidence"] + math.log(r["path_rate"] / (1 - r["path_rate"]))
        assert math.isclose(r["quality"], 1 / (1 + math.exp(-odds)), rel_tol=1e-9)


def test_one_class_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "s", "en")], "doc_id int, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id int, quality int")
    (row,) = score_quality(docs, labels).collect()
    assert row["kept"] and row["quality"] is None
    assert score_quality(docs.limit(0), labels).count() == 0
    assert score_quality(docs, labels.limit(0)).count() == 1


def test_logistic_is_at_its_optimum():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(500, 3))
    y = (x[:, 0] + draw.normal(size=500) > 0).astype(float)
    own = Logistic.fit(x, y)
    z = (x - np.array(own.mean)) / np.array(own.scale)
    design = np.hstack([z, z * z])
    p = 1 / (1 + np.exp(-(design @ np.array(own.weights) + own.bias)))
    assert np.abs(design.T @ (y - p) - np.array(own.weights)).max() < 1e-6
    assert own.weights[0] == pytest.approx(max(own.weights))
