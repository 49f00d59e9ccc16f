"""Near duplicates against all pairs, components against a search."""

import random

import pytest
from pyspark.sql import functions as F

from seasoncast.llm import near_dedup
from seasoncast.llm.components import components


def shingles(text, words):
    own = (text or "").encode().lower().split()
    size = min(words, len(own))
    return frozenset(tuple(own[i : i + size]) for i in range(len(own) - size + 1)) if own else frozenset()


def brute(rows, words, percent=80):
    sets = [(i, shingles(t, words)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(draw, words, n):
    own = list(words)
    for _ in range(n):
        own[draw.randrange(len(own))] = f"new{draw.randrange(9**6)}"
    return " ".join(own)


def fixture():
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n", "one", "One", "two words", "TWO\twords", "é É", "é é"]
    for group in range(12):
        words = draw.choices(vocabulary, k=draw.randint(20, 120))
        texts += [edited(draw, words, draw.randint(0, 6)) for _ in range(draw.choice([2, 3, 12]))]
    # A large group of near copies, and many documents that share half of their words.
    words = draw.choices(vocabulary, k=150)
    texts += [edited(draw, words, draw.randint(0, 9)) for _ in range(90)]
    texts += [" ".join(words[:75] + draw.choices(vocabulary, k=75)) for _ in range(40)]
    texts += ["copy of a text " * 30] * 50 + [" ".join(map(str, range(30_000)))] * 2
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("carried", [2_048, 100])
def test_equals_all_pairs(spark, monkeypatch, carried):
    monkeypatch.setattr(near_dedup, "CARRIED", carried)
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = fixture()
    docs = spark.createDataFrame([*rows, (None, "one"), (3, rows[3][1])], "doc_id int, text string")
    docs = docs.withColumn("n", F.lit("x")).withColumn("kept", F.lit("x")).repartition(8)
    got = near_dedup.near_duplicates(docs, words=2).collect()
    assert len(got) == len(rows) + 2
    want = brute(rows, 2)
    for r in got:
        if r["doc_id"] is None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (1, None, True)
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_regions_go_deeper(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 20)
    trees = spark.range(100).select(
        F.col("id").alias("rep"),
        F.lit(5).alias("n"),
        F.lit(0).alias("tree"),
        F.lit(1).cast("long").alias("key"),
        (F.col("id") % 10 * F.lit(1 << 48)).alias("deep"),
    )
    got = near_dedup._regions(trees).collect()
    assert len(got) == 100 and {r["size"] for r in got} == {10}


def test_links_across_deeper_regions(spark, monkeypatch):
    """Linked pairs that agree on the first values of a tree but on the deeper ones of none."""
    monkeypatch.setattr(near_dedup, "REGION", 1)
    own = near_dedup.Shingler(1)
    texts = []
    for n in range(400):
        words = [f"p{n}w{i}" for i in range(90)]
        pair = [" ".join(words[:80] + words[80:85]), " ".join(words[:80] + words[85:])]
        pair = [t + "".join(f" p{n}{side}{i}" for i in range(4)) for side, t in zip("xy", pair)]
        (a, deep_a), (b, deep_b) = (own.order_keys(own.signature(own.shingles(t))) for t in pair)
        if (a == b).any() and not ((a == b) & (deep_a == deep_b)).any():
            texts += pair
    rows = list(enumerate(texts))
    assert len(rows) >= 8
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(2)
    got = near_dedup.near_duplicates(docs, words=1).collect()
    want = brute(rows, 1)
    assert {i for _, i in want.values()} == set(range(0, len(rows), 2))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert near_dedup.near_duplicates(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(300, i) for i in range(301, 340)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (9, 8)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 300 for i in range(300, 340)} | {8: 8, 9: 8}
