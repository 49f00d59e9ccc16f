"""Reading the given tables, and batches that keep a worker's memory small."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a worker turns into Python objects at once.
SLICE_ROWS = 128


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """About ``most`` of ``rows``, a stored table, or all if there are fewer: those with the
    smallest hashes of ``keys``. The driver gets no more than that, however many tasks there are.
    """
    many, steps = rows.count(), 1 << 30
    if many <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(*keys), F.lit(steps)) < int(steps * most / many))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_slices(
    df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType
) -> DataFrame:
    """``make`` on a few rows at a time; nothing else of a partition is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(make, slices(batches))

    return df.mapInArrow(run, schema)
