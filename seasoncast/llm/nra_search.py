"""Ranked lexical search without random access: impact-sorted lists read side by side.

Documents are dealt into shards. In a shard each query term has a list of its documents, sorted by
impact. A search reads the lists of its terms from the front, a block of each a round. What was
read is a document's lower score; the next impact of every list that it was not met in yet bounds
what may still come. Reading stops when the best documents, their order and their scores can no
longer change. The best of all shards are merged by Spark, so the result is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.llm.common import slices
from seasoncast.sources.shared import cut_lineage

# A-Z are lower-cased; these bytes separate terms, all others belong to them.
_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]

#: Bytes of different terms that are sought in one pass over the documents.
BLOCK_BYTES = 16_000_000
#: Documents and postings of a shard, and entries read from a list in the first round; they double.
SHARD_DOCS, SHARD_POSTINGS, FIRST_READ = 8_192, 4_000_000, 128


def _translation() -> bytes:
    table = bytearray(range(256))
    table[65:91] = bytes(range(97, 123))
    for byte in _SEPARATORS:
        table[byte] = 0x20
    return bytes(table)


_TABLE = _translation()


def terms_of(raw: bytes | None) -> list[bytes]:
    """Terms of a whole text in UTF-8, in order; null has none."""
    return (raw or b"").translate(_TABLE).split()


class Index(NamedTuple):
    """Documents with the terms that are sought, and the counts that scores need."""

    rows: DataFrame  # doc_id, n, terms, tfs
    n_docs: int
    n_terms: int
    df: dict[int, int]


def index_documents(docs: DataFrame, number: dict[bytes, int]) -> Index:
    """Occurrences of the terms of ``number`` in all ``docs``, a row a document with any term."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, sizes, terms, tfs = [], [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(raw)
                if found:
                    many = Counter(found)
                    sought = [(number[t], n) for t, n in many.items() if t in number]
                    ids.append(doc_id)
                    sizes.append(len(found))
                    terms.append([t for t, _ in sought])
                    tfs.append([n for _, n in sought])
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(tfs, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    raw = F.col("text").cast("string").cast("binary")
    rows = cut_lineage(
        docs.select(F.col("doc_id").cast("long"), raw.alias("text")).mapInArrow(
            read, "doc_id long, n long, terms array<int>, tfs array<long>"
        )
    )
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = rows.select(F.explode("terms").alias("term")).groupBy("term").count()
    # One row for each sought term at most.
    return Index(rows, n_docs, n_terms, {r[0]: r[1] for r in holding.collect()})


class Shard:
    """Impact-sorted lists of some documents, numbered in the order in which ties are settled."""

    def __init__(
        self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, index: Index
    ):
        self.n_docs = len(n)
        m = 75 + (25 * n * index.n_docs) // index.n_terms
        doc = np.repeat(np.arange(len(n)), sizes)
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[doc])
        order = np.lexsort((doc, -impact, terms))
        self._docs, self._impacts = doc[order], impact[order]
        names, starts = np.unique(terms[order], return_index=True)
        ends = [*starts[1:].tolist(), len(order)]
        self._at = dict(zip(names.tolist(), zip(starts.tolist(), ends)))

    def search(self, weights: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best documents with a score above 0 and their scores, best first."""
        lists = []
        for term, weight in weights.items():
            if weight and term in self._at:
                start, end = self._at[term]
                lists.append((self._docs[start:end], self._impacts[start:end] * weight))
        lower = np.zeros(self.n_docs, dtype=np.int64)
        done, read = 0, FIRST_READ
        while True:
            covered = np.zeros(self.n_docs, dtype=np.int64)
            to_come = 0
            for docs, gains in lists:
                lower[docs[done:read]] += gains[done:read]
                if read < len(docs):
                    to_come += int(gains[read])
                    covered[docs[:read]] += gains[read]
            upper = lower + (to_come - covered)
            best = self._settled(lower, upper, k)
            if best is not None:
                return best, lower[best]
            done, read = read, 2 * read

    @staticmethod
    def _settled(lower: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray | None:
        """The best documents, or None while reading on may change them or their scores."""
        best = np.flatnonzero(lower)
        if len(best) > k:
            least = np.partition(lower[best], -k)[-k]
            best = best[lower[best] >= least]
        best = best[np.lexsort((best, -lower[best]))][:k]
        if (upper[best] != lower[best]).any():
            return None
        # Others must stay below the last one, or come after it where they reach its score.
        floor, last = (lower[best[-1]], best[-1]) if len(best) == k else (0, -1)
        rivals = upper >= floor
        rivals[last + 1 :] = upper[last + 1 :] > floor
        rivals[best] = False
        return None if rivals.any() else best


def _best_of_shards(
    index: Index, searches: list[tuple[int, dict[int, int]]], k: int
) -> DataFrame:
    """``item, doc_id, score``: the ``k`` best of every shard for every search."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        n_docs = n_postings = 0
        for batch in slices(batches, 1_024):
            held.append(batch)
            n_docs += batch.num_rows
            n_postings += len(batch.column(2).flatten())
            if n_docs >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
                yield pa.Table.from_batches(held)
                held, n_docs, n_postings = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches):
            table = table.sort_by([("doc_id", "ascending")]).combine_chunks()
            ids, n, terms, tfs = (table.column(i).combine_chunks() for i in range(4))
            sizes = np.asarray(terms.value_lengths())
            shard = Shard(
                np.asarray(n), sizes, np.asarray(terms.flatten()), np.asarray(tfs.flatten()), index_counts
            )
            for item, weights in searches:
                best, scores = shard.search(weights, k)
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(best), item), pa.int64()),
                        ids.take(pa.array(best)),
                        pa.array(scores, pa.int64()),
                    ],
                    names=["item", "doc_id", "score"],
                )

    index_counts = index._replace(rows=None, df={})
    return index.rows.mapInArrow(search, "item long, doc_id long, score long")


def _blocks_of_items(items: DataFrame, item_col: str) -> Iterator[dict[int | None, Counter]]:
    """Terms of the items, some items at a time, so that a block's terms are bounded in size."""
    given = items.select(
        F.col(item_col).cast("long").alias("item"), F.col("text").cast("string").cast("binary").alias("text")
    )
    size = given.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    many = max(1, math.ceil(size / BLOCK_BYTES))
    for block in range(many):
        own = given.filter(F.pmod(F.xxhash64("item"), F.lit(many)) == block)
        found: dict[int | None, Counter] = {}
        for item, raw in own.toLocalIterator():
            found.setdefault(item, Counter()).update(terms_of(raw and bytes(raw)))
        yield found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, best first.

    Terms are runs of digits, letters and all beyond ASCII, A-Z lower-cased. With N documents that
    have a term, L terms in all of them and n in the document, m is 75 + (25 * n * N) div L. A term
    that df documents hold has the weight floor(1000 * ln((2N + 2) / (2df + 1))); its impact is
    (10^9 * tf) div (1000 * tf + 12 * m). The score sums weight times impact over the item's terms,
    repeats included. Only scores above 0 are listed; equal ones go by doc_id, null ids last.
    Repeated rows are documents of their own. Rows that share an item id are one item with the
    terms of all. Items without terms and empty tables give no rows; other columns are not read.
    Documents are read once for each ``BLOCK_BYTES`` of item texts.
    """
    spark = docs.sparkSession
    parts = spark.createDataFrame([], f"{item_col} long, doc_id long, score long")
    for found in _blocks_of_items(items, item_col):
        number = {t: i for i, t in enumerate(sorted(set().union(*found.values())))}
        if not number:
            continue
        index = index_documents(docs, number)
        if not index.n_terms:
            continue
        weights = {t: weight(index.n_docs, df) for t, df in index.df.items()}
        names = list(found)
        searches = []
        for i, item in enumerate(names):
            own = {number[t]: many * weights.get(number[t], 0) for t, many in found[item].items()}
            searches.append((i, own))
        best = _best_of_shards(index, searches, k)
        named = spark.createDataFrame(list(enumerate(names)), f"item long, {item_col} long")
        parts = parts.unionByName(best.join(named, "item").select(item_col, "doc_id", "score"))
    order = Window.partitionBy(item_col).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(item_col, "rank", "doc_id", "score")
