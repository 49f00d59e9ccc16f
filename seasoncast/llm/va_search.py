"""Exact top-k inner product search with vector-approximation files.

The approximation file holds, for blocks of vectors, one byte a component: the number of the cell
between the block's least and greatest value in which the component lies. A scan over it bounds
every score from both sides. Exact vectors are read for candidates in the order of their upper
bounds, first a batch, then whatever could still reach the kth score found in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.llm.vectors import all_finite, blocks, distinct_vectors, stacked
from seasoncast.sources.shared import cut_lineage

#: Vectors in a block of the approximation file, queries in a block of queries.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 64
CELLS = 64
#: Exact vectors read for a query before the first test whether the kth result is certain.
FIRST_READ = 16


def to_integers(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` for each component, a whole number as a double. One that is no finite
    double raises."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        error = F.raise_error(F.lit("a scaled component is not finite")).cast("double")
        # Beyond 2^53 doubles are whole numbers; adding 0 leaves no negative zero.
        floor = F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y) + 0.0
        return F.when(F.abs(y) < math.inf, floor).otherwise(error)

    return F.transform(vector, whole)


def _approximate(rows: pd.DataFrame) -> pd.DataFrame:
    exact = stacked(rows["vec"])
    low, high = exact.min(axis=0), exact.max(axis=0)
    # Halves, since a difference of huge values may be beyond all doubles.
    half_step = np.maximum((high / 2 - low / 2) / CELLS, 1e-300)
    cells = np.minimum((exact / 2 - low / 2) // half_step, CELLS - 1).astype(np.uint8)
    return pd.DataFrame(
        {
            "dim": [exact.shape[1]],
            "block": [rows["block"].iloc[0]],
            "low": [low],
            "half_step": [half_step],
            "ids": [rows["rep"].to_numpy()],
            "cells": [cells.tobytes()],
        }
    )


APPROXIMATION = "dim int, block int, low array<double>, half_step array<double>, ids array<long>, cells binary"


def approximation_file(vectors: DataFrame, n_rows: int) -> DataFrame:
    """A row for each block of ``rep, vec``."""
    dealt, _ = blocks(vectors.withColumn("dim", F.size("vec")), "rep", BLOCK_VECTORS, n_rows)
    return dealt.groupBy("dim", "block").applyInPandas(_approximate, APPROXIMATION)


def _bounded(k: int):
    """Candidates of a block of queries in a block of vectors, with bounds of the score."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                query = np.asarray(row.queries, dtype=np.float64).reshape(-1, row.dim)
                cells = np.frombuffer(row.cells, dtype=np.uint8).reshape(-1, row.dim)
                low = 2 * (row.low / 2 + cells * row.half_step)
                high = 2 * (row.low / 2 + (cells + 1.0) * row.half_step)
                plus, minus = np.maximum(query, 0), np.minimum(query, 0)
                with np.errstate(over="ignore", invalid="ignore"):
                    least = plus @ low.T + minus @ high.T
                    most = plus @ high.T + minus @ low.T
                    slack = 1e-9 * (np.abs(query) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-6
                    least, most = least - slack, most + slack
                # Beyond all doubles a bound says nothing.
                least[np.isnan(least)], most[np.isnan(most)] = -np.inf, np.inf
                n = least.shape[1]
                kth = np.partition(least, n - k, axis=1)[:, n - k] if n > k else least.min(axis=1)
                q, v = np.nonzero(most >= kth[:, None])
                yield pd.DataFrame(
                    {
                        "query": np.asarray(row.query_ids)[q],
                        "rep": np.asarray(row.ids)[v],
                        "least": least[q, v],
                        "most": most[q, v],
                    }
                )

    return scan


def _exact_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scores in integers of any size; those beyond a long are held at its ends and marked."""
    most = np.iinfo(np.int64).max
    for batch in batches:
        sums = [
            sum(int(a) * int(b) for a, b in zip(q, v)) for q, v in zip(batch["_q"], batch["_v"])
        ]
        yield pd.DataFrame(
            {
                "query": batch["query"],
                "rep": batch["rep"],
                "score": np.array([max(-most, min(most, x)) for x in sums], dtype=np.int64),
                "beyond": [abs(x) > most for x in sums],
            }
        )


def _with_exact(found: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``query, rep, score, beyond``; products that may leave 64 bits are summed in Python."""

    def largest(vector: str) -> Column:
        return F.array_max(F.transform(vector, F.abs))

    pairs = (
        found.select("query", "rep")
        .join(queries.select(F.col("rep").alias("query"), F.col("vec").alias("_q")), "query")
        .join(vectors.select("rep", F.col("vec").alias("_v")), "rep")
    )
    fits = (F.size("_q") * largest("_q") * largest("_v") < 2.0**62) & (
        F.greatest(largest("_q"), largest("_v")) < 2.0**62
    )
    product = F.aggregate(
        F.zip_with("_q", "_v", lambda a, b: a.cast("long") * b.cast("long")),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    common = pairs.filter(fits).select(
        "query", "rep", product.alias("score"), F.lit(False).alias("beyond")
    )
    schema = "query long, rep long, score long, beyond boolean"
    large = pairs.filter(~fits).select("query", "rep", "_q", "_v")
    return common.unionByName(large.mapInPandas(_exact_sums, schema))


def _pack_queries(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "dim": [rows["dim"].iloc[0]],
            "q_block": [rows["block"].iloc[0]],
            "query_ids": [rows["rep"].to_numpy()],
            "queries": [stacked(rows["vec"]).ravel()],
        }
    )


def top_vectors(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query, rep, score, beyond``: the ``k`` vectors of the largest inner product for each query,
    ties to the smaller ``rep``. Both sides are ``rep, vec`` with whole components and unique ids;
    only vectors of the query's dimension are compared. ``beyond`` marks scores that are no long.
    """
    n_queries = queries.count()
    va = cut_lineage(approximation_file(vectors, vectors.count()))
    dealt, many = blocks(queries.withColumn("dim", F.size("vec")), "rep", BLOCK_QUERIES, n_queries)
    packed = dealt.groupBy("dim", "block").applyInPandas(
        _pack_queries, "dim int, q_block int, query_ids array<long>, queries array<double>"
    )
    # Each block of queries meets each block of vectors, as the search asks for.
    pairs = va.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).join(
        packed, ["dim", "q_block"]
    )
    schema = "query long, rep long, least double, most double"
    bounded = cut_lineage(pairs.mapInPandas(_bounded(k), schema))

    by_least = Window.partitionBy("query").orderBy(F.desc("least"), "rep")
    sure = (
        bounded.withColumn("_n", F.row_number().over(by_least))
        .filter(F.col("_n") <= k)
        .groupBy("query")
        .agg(F.when(F.count("*") == k, F.min("least")).alias("_sure"))
    )
    possible = bounded.join(sure, "query").filter(
        F.col("_sure").isNull() | (F.col("most") >= F.col("_sure"))
    )
    by_most = Window.partitionBy("query").orderBy(F.desc("most"), "rep")
    ordered = cut_lineage(
        possible.select("query", "rep", "most", F.row_number().over(by_most).alias("place"))
    )
    first = cut_lineage(_with_exact(ordered.filter(F.col("place") <= FIRST_READ), queries, vectors))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    kth = (
        first.withColumn("_n", F.row_number().over(by_score))
        .filter(F.col("_n") == k)
        .select("query", F.col("score").alias("_kth"))
    )
    rest = (
        ordered.filter(F.col("place") > FIRST_READ)
        .join(kth, "query", "left")
        .filter(F.col("_kth").isNull() | (F.col("most") >= F.col("_kth")))
    )
    every = first.unionByName(_with_exact(rest, queries, vectors))
    return (
        every.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") <= k).drop("_n")
    )


def search(
    rows: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: float = 256.0,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of which ``is_query`` (over ``id``) holds.

    Candidates are all rows but the query's own. Scores are inner products of ``floor(scale * x)``,
    exact for components of any size; one that is to be listed and does not fit a long raises. Ties
    go to the smaller id. Vectors that are null, empty or hold a null or non-finite component
    take no part, nor do null ids; fewer candidates than ``k`` give fewer rows; a row that repeats
    its id counts once for each different vector. Equal vectors are searched once.
    """
    taking = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")
    ).filter(F.col("id").isNotNull() & all_finite(F.col("vec")))
    whole = taking.select("id", to_integers(F.col("vec"), scale).alias("vec"))
    vectors = cut_lineage(distinct_vectors(whole.distinct(), k + 1))
    asked = whole.filter(is_query).distinct()
    asking = cut_lineage(
        asked.join(vectors.select("vec", "rep"), "vec").select(
            F.col("id").alias("query_id"), "rep", "vec"
        )
    )
    queries = cut_lineage(asking.select("rep", "vec").distinct())
    found = top_vectors(vectors.select("rep", "vec"), queries, k + 1)
    members = found.join(vectors.select("rep", "members"), "rep").select(
        F.col("query").alias("_query"), F.explode("members").alias("vec_id"), "score", "beyond"
    )
    own = Window.partitionBy("_query").orderBy(F.desc("score"), "vec_id")
    lists = members.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= k + 1)
    rank = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    )
    error = F.raise_error(F.lit("a score does not fit 64 bits")).cast("long")
    return (
        asking.select("query_id", F.col("rep").alias("_query"))
        .join(lists, "_query")
        .filter(F.col("query_id") != F.col("vec_id"))
        .select("query_id", rank.alias("rank"), "vec_id", "score", "beyond")
        .filter(F.col("rank") <= k)
        .select(
            "query_id", "rank", "vec_id", F.when(F.col("beyond"), error).otherwise(F.col("score")).alias("score")
        )
    )
