"""NRA search against all scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasoncast.llm import nra_search
from seasoncast.llm.nra_search import Index, Shard, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(d, plain_terms(t)) for d, t in docs]
    counted = [(d, len(w), Counter(w)) for d, w in counted if w]
    n_docs, total = len(counted), sum(n for _, n, _ in counted)
    df = Counter(t for _, _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, Counter()).update(plain_terms(text))
    out = []
    for item, own in wanted.items():
        scores = []
        for d, n, c in counted:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(
                many
                * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, many in own.items()
                if t in c
            )
            if score > 0:
                scores.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k]):
            out.append((item, rank + 1, d, -score))
    return sorted(out, key=str)


def found(docs, items, k):
    return sorted((tuple(r) for r in search(docs, items, k).collect()), key=str)


def made(seed, n_docs, n_items):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(n_docs)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(60)]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(n_items)]
    return docs, items


def test_terms():
    for text in [None, "", "A-b c'D_e9 É x　Z\x7f[q]`{|}@:/0", "日本\nİ x"]:
        raw = text.encode() if text is not None else None
        assert [t.decode() for t in terms_of(raw)] == plain_terms(text)


@pytest.mark.parametrize("shard,read,block", [(8192, 128, 10**6), (16, 1, 10**6), (50, 3, 200)])
def test_equals_all_scores(spark, monkeypatch, shard, read, block):
    monkeypatch.setattr(nra_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(nra_search, "FIRST_READ", read)
    monkeypatch.setattr(nra_search, "BLOCK_BYTES", block)
    docs, items = made(shard, 300, 25)
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    assert found(frame, spark.createDataFrame(items, ITEMS), 5) == brute(docs, items, 5)


def test_cases(spark):
    docs = [
        (3, "Alpha beta beta"), (3, "Alpha beta beta"), (None, "alpha gamma"), (5, None), (6, ""),
        (7, "!!! \n"), (8, "delta " * 20_000 + "alpha"), (-2, "ALPHA gamma"), (9, "gamma"),
    ]
    items = [
        (1, "alpha, beta"), (2, "beta BETA beta"), (3, None), (4, ""), (5, "unseen"),
        (None, "gamma"), (6, "delta"), (6, "gamma"), (7, "gamma " * 5000),
    ]
    frame = spark.createDataFrame(docs, DOCS).withColumns({"score": F.lit("x"), "n": F.lit(1)})
    asked = spark.createDataFrame(items, ITEMS).withColumns({"rank": F.lit(0), "item": F.lit("y")})
    assert found(frame, asked, 20) == brute(docs, items, 20)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b")], ITEMS)
    assert search(docs, some).count() == 0
    assert search(some.withColumnRenamed("item_id", "doc_id"), items).count() == 0
    assert search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_reading_stops_early():
    """Rivals whose bound is below the kth score are never read."""
    n = 4096
    terms = np.zeros(n, dtype=np.int32)
    tfs = np.r_[np.full(8, 1000), np.ones(n - 8)].astype(np.int64)
    sizes = np.full(n, 1000, dtype=np.int64)
    shard = Shard(sizes, np.ones(n, dtype=np.int64), terms, tfs, Index(None, n, n * 1000, {}))
    seen = []
    settled = Shard._settled

    def counting(lower, upper, k):
        seen.append(int((lower > 0).sum()))
        return settled(lower, upper, k)

    shard._settled = counting
    best, scores = shard.search({0: 7}, 5)
    assert best.tolist() == [0, 1, 2, 3, 4] and len(set(scores.tolist())) == 1
    assert seen == [nra_search.FIRST_READ]
