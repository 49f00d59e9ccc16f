"""Best-fit packing of token pieces into sequences under several capacities.

Pieces of one length are interchangeable, so the heuristic runs on the number of pieces of each
length (at most ``tokens`` numbers) and on classes of bins in the same state: classes are split
at most twice for each length that enters them, so its work does not grow with the data. Spark
counts the lengths, numbers the pieces of each length, and gives each numbered piece the place
that the heuristic found for its number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.sources.shared import cut_lineage

#: Pieces that one task numbers, about.
BUCKET_ROWS = 20_000
#: Numbers of one length that one task places.
BLOCK_ROWS = 4_096


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence: tokens, documents, and attention cost (sum of squared lengths)."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048

    def as_array(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.float64)


@dataclass(frozen=True)
class Choice:
    """How a bin is chosen among those in which the piece fits.

    ``norm`` takes the smallest weighted norm of what would be left, ``dot`` the largest weighted
    dot product of piece and room. Room is measured as a share of each capacity.
    """

    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)

    def score(self, room: np.ndarray, item: np.ndarray) -> np.ndarray:
        w = np.asarray(self.weights)
        if self.rule == "norm":
            return ((room - item) ** 2) @ w
        if self.rule == "dot":
            return -(room * item) @ w
        raise ValueError(f"no such rule: {self.rule}")


class _Bins:
    """Classes of open bins: room left, first sequence, number of sequences."""

    def __init__(self, cap: np.ndarray):
        self.cap = cap
        self.room = np.empty((64, 3))
        self.first = np.empty(64, dtype=np.int64)
        self.many = np.empty(64, dtype=np.int64)
        self.n = 0
        self.made = 0

    def add(self, room: np.ndarray, first: int, many: int) -> None:
        if self.n == len(self.many):
            keep = np.flatnonzero((self.room > 0).all(axis=1) & (self.many > 0))
            size = max(64, 2 * len(keep))
            for name in ("room", "first", "many"):
                old = getattr(self, name)
                new = np.empty((size, *old.shape[1:]), dtype=old.dtype)
                new[: len(keep)] = old[keep]
                setattr(self, name, new)
            self.n = len(keep)
        self.room[self.n], self.first[self.n], self.many[self.n] = room, first, many
        self.n += 1

    def open(self, many: int) -> None:
        self.add(self.cap, self.made, many)
        self.made += many


def best_fit(counts: dict[int, int], capacity: Capacity, choice: Choice) -> pd.DataFrame:
    """Places for ``counts[length]`` pieces of each length, long ones first.

    A row says: numbers ``rank0`` to ``rank1`` (exclusive) of ``length`` go, ``each`` to a
    sequence, to the sequences from ``seq0`` on, from token ``offset0`` on.
    """
    cap = capacity.as_array()
    bins, out = _Bins(cap), []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        item = np.array([length, 1, length * length], dtype=np.float64)
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left > 0:
            room, many = bins.room[: bins.n], bins.many[: bins.n]
            fits = np.flatnonzero((room >= item).all(axis=1) & (many > 0))
            if not len(fits):
                each = int((cap // item).min())
                bins.open(-(-left // each))
                continue
            at = int(fits[np.argmin(choice.score(room[fits] / cap, item / cap))])
            each = int((room[at] // item).min())
            first, have, was = int(bins.first[at]), int(bins.many[at]), room[at].copy()
            full = min(left // each, have)
            offset = int(cap[0] - was[0])
            bins.many[at] = 0
            if full:
                out.append((length, rank, rank + full * each, each, first, offset))
                bins.add(was - each * item, first, full)
            rank, left = rank + full * each, left - full * each
            first, have = first + full, have - full
            if have and left:
                out.append((length, rank, rank + left, left, first, offset))
                bins.add(was - left * item, first, 1)
                first, have, rank, left = first + 1, have - 1, rank + left, 0
            if have:
                bins.add(was, first, have)
    return pd.DataFrame(
        out, columns=["length", "rank0", "rank1", "each", "seq0", "offset0"], dtype="int64"
    )


def _numbered(pieces: DataFrame, by: Sequence[Column], rows: int) -> DataFrame:
    """``rank`` of a piece among those of its length, from 0, without one task a length."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    sizes = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_many"))
    before = F.sum("_many").over(
        Window.partitionBy("length")
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    starts = sizes.select("length", "_bucket", (before - F.col("_many")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*by))
    return (
        salted.withColumn("_within", within)
        .join(starts, ["length", "_bucket"])
        .withColumn("rank", F.col("_before") + F.col("_within") - 1)
        .drop("_bucket", "_within", "_before")
    )


def pack(
    pieces: DataFrame,
    capacity: Capacity = Capacity(),
    choice: Choice = Choice(),
) -> DataFrame:
    """``pieces`` (any columns, with ``length``) plus ``sequence_id`` and ``offset``.

    Each piece is placed whole. Sequences hold their pieces without gaps from offset 0. Pieces
    of no tokens or of null length take no part; one beyond a capacity raises. Equal rows are
    packed once each; an empty table gives an empty one. Columns named ``sequence_id``,
    ``offset``, ``rank`` or with a leading underscore are not carried.
    """
    spark = pieces.sparkSession
    own = [
        c
        for c in pieces.columns
        if c not in ("sequence_id", "offset", "rank") and not c.startswith("_")
    ]
    base = cut_lineage(
        pieces.select(*own).withColumn("length", F.col("length").cast("long")).filter("length > 0")
    )
    counts = {r["length"]: r["count"] for r in base.groupBy("length").count().collect()}
    places = best_fit(counts, capacity, choice)
    schema = "length long, rank0 long, rank1 long, each long, seq0 long, offset0 long"
    table = spark.createDataFrame(places, schema).withColumn(
        "_block",
        F.explode(
            F.sequence(
                F.floor(F.col("rank0") / BLOCK_ROWS), F.floor((F.col("rank1") - 1) / BLOCK_ROWS)
            )
        ),
    )
    # A place meets the numbers of its block in rank order: the last place before a number is its own.
    marks = table.select(
        "length",
        "_block",
        F.greatest("rank0", F.col("_block") * BLOCK_ROWS).alias("rank"),
        F.struct("rank0", "each", "seq0", "offset0").alias("_place"),
    )
    rows = _numbered(base, [F.col(c) for c in own], sum(counts.values())).withColumns(
        {"_block": F.floor(F.col("rank") / BLOCK_ROWS), "_piece": F.struct(*own)}
    )
    both = rows.select("length", "_block", "rank", "_piece").unionByName(
        marks, allowMissingColumns=True
    )
    order = (
        Window.partitionBy("length", "_block")
        .orderBy("rank", F.col("_piece").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = both.withColumn("_at", F.last("_place", ignorenulls=True).over(order)).filter(
        "_piece IS NOT NULL"
    )
    number = F.col("rank") - F.col("_at.rank0")
    return placed.select(
        "_piece.*",
        (F.col("_at.seq0") + F.floor(number / F.col("_at.each"))).alias("sequence_id"),
        (F.col("_at.offset0") + number % F.col("_at.each") * F.col("length")).alias("offset"),
    )
