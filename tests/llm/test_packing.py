"""Packing: every piece once, no gaps, no capacity broken, few sequences."""

import random

import pytest
from pyspark.sql import functions as F

from seasoncast.llm.bin_packing import Capacity, Choice, best_fit, pack


def one_by_one(lengths, capacity, choice):
    """The heuristic on single pieces: number of sequences."""
    import numpy as np

    cap, bins = capacity.as_array(), []
    for length in sorted(lengths, reverse=True):
        item = np.array([length, 1, length * length], dtype=float)
        fits = [i for i, b in enumerate(bins) if (b >= item).all()]
        if fits:
            scores = choice.score(np.array([bins[i] for i in fits]) / cap, item / cap)
            bins[fits[int(np.argmin(scores))]] -= item
        else:
            bins.append(cap - item)
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [Capacity(40, 40, 1600), Capacity(40, 3, 1600), Capacity(40, 40, 500)])
def test_places_keep_every_capacity(rule, capacity):
    draw = random.Random(4)
    lengths = [draw.randint(1, 20) for _ in range(400)] + [7] * 200
    counts = {n: lengths.count(n) for n in set(lengths)}
    choice = Choice(rule)
    bins, seen = {}, {n: [] for n in counts}
    for row in best_fit(counts, capacity, choice).itertuples():
        seen[row.length] += range(row.rank0, row.rank1)
        for rank in range(row.rank0, row.rank1):
            number = rank - row.rank0
            at = row.offset0 + number % row.each * row.length
            bins.setdefault(row.seq0 + number // row.each, []).append((at, row.length))
    assert all(sorted(seen[n]) == list(range(counts[n])) for n in counts)
    for own in bins.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0
        assert sum(n for _, n in own) <= capacity.tokens
        assert len(own) <= capacity.documents
        assert sum(n * n for _, n in own) <= capacity.attention
    # Pieces of one length that go together may cost a sequence or two against one at a time.
    assert len(bins) <= 1.02 * one_by_one(lengths, capacity, choice) + 2


def test_pack_in_spark(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice([5, 5, 5, 64, draw.randint(1, 64)])) for i in range(3000)]
    rows += [(7, 5)] * 40 + [(None, 9), (8, None), (9, 0)]
    pieces = spark.createDataFrame(rows, "doc_id int, length int").withColumn("offset", F.lit("x"))
    got = pack(pieces, Capacity(64, 64, 64 * 64)).collect()
    wanted = [n for _, n in rows if n]
    assert sorted(r["length"] for r in got) == sorted(wanted)
    assert sum(r["doc_id"] is None for r in got) == 1
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert sum(n for _, n in own) <= 64
    # Fives fill 60 of 64 tokens where nothing smaller is left.
    assert len(bins) <= 1.02 * sum(wanted) / 64


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id int, length int")
    assert pack(empty).collect() == []
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 65)], "doc_id int, length int"), Capacity(64))
