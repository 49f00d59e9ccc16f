"""Nearest-neighbour imputation of month columns.

A missing month of a row becomes the mean of that month over the two nearest rows that have
it. The distance uses the months both rows have: ``sqrt(T / common * sum of squared
differences)``; equal distances go to the smaller value. A cell without any comparable row
gets the mean of its column.

Rows are never paired off in full. Each panel is cut into tiles of similar rows: halving all
months in turn gives an order, and a tile is a stretch of it. A tile keeps the range of each month
and the patterns of missing months among its rows, which bound the distance of any row to any of
the tile's from below, whatever months they share; in an opened tile, each pattern has its own. Each cell is settled on its own: one look
into the tile with the least bound gives it a radius, then the tiles within that radius are opened,
and no others. A cell whose month hardly anyone has looks into the tiles of those few only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasoncast.operators.ranking import with_row_index
from seasoncast.operators.reshape import INDEX
from seasoncast.sources.shared import cut_lineage

NEIGHBOURS = 2
#: Rows of a tile at least; a panel of more than the square of it has tiles of the root of its rows.
TILE_ROWS = 1024
#: Tiles whose bounds go together, and halvings of each month in the order of rows.
PACK_TILES, HALVINGS = 256, 5
_SLACK, _LAST = 1e-9, np.finfo(float).max
_FOUND = "_id bigint, _m int, s double, y double"
_TOP = "array<struct<s: double, y: double>>"


def knn_impute(
    wide: DataFrame,
    months: Sequence[int],
    group_cols: Sequence[str] = (),
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Fill the gaps of a wide table, panel by panel; a column without values raises."""
    keys = list(group_cols)
    nan = F.lit(float("nan"))
    vector = F.array(*[F.coalesce(F.col(str(m)), nan) for m in months])
    rows = cut_lineage(wide.withColumn("_v", vector))
    # Copies of a row count as one vector; two of them suffice as neighbours.
    vectors = cut_lineage(
        rows.groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns(
            {
                "_w": F.least("_n", F.lit(NEIGHBOURS)).cast("int"),
                "_gaps": F.size(F.filter("_v", F.isnan)),
                "_id": F.monotonically_increasing_id(),
            }
        )
    )
    filled = _fill(vectors, _nearest(vectors, len(months), keys, tile_rows), len(months), keys)
    # Complete rows stay out of the join.
    gap = F.exists("_v", F.isnan)
    cells = [
        F.coalesce(F.nanvl(F.col(str(m)), F.lit(None)), F.get("_fill", F.lit(i))).alias(str(m))
        for i, m in enumerate(months)
    ]
    mended = rows.filter(gap).join(filled, [*keys, "_v"]).select(*keys, *INDEX, *cells)
    return rows.filter(~gap).select(*keys, *INDEX, *map(str, months)).unionByName(mended)


def _nearest(vectors: DataFrame, n: int, keys: list[str], tile_rows: int) -> DataFrame:
    """``_id, _m, _top``: the best two (squared distance, value) of each missing month."""
    spark = vectors.sparkSession
    # A row without any month is near nothing; one panel without a key still joins on one.
    some = vectors.filter(F.col("_gaps") < n).withColumn("_panel", F.lit(0))
    by = ["_panel", *keys]
    if some.filter("_gaps > 0").isEmpty():
        return spark.createDataFrame([], f"_id bigint, _m int, _top {_TOP}")
    placed = cut_lineage(_tiled(some, n, by, tile_rows))
    tiles = cut_lineage(
        _gathered(placed, [*by, "_tile"], F.struct("_v", "_w"), "_rows").select(
            *by, "_tile", F.flatten("_rows._v").alias("_y"), F.col("_rows._w").alias("_copies")
        )
    )
    packs = cut_lineage(_packs(tiles, n, by))
    everywhere = F.array_repeat(F.lit(float("inf")), n).alias("_r")
    seeking = placed.filter("_gaps > 0").select(*by, "_tile", "_id", "_v", everywhere)

    first = _looks(seeking, packs, n, by, None)
    nearest = first.groupBy("_id", "_m").agg(F.min(F.struct("far", "tile")).alias("_b"))
    nearest = nearest.select("_id", F.col("_b.tile").alias("tile")).distinct()
    looked = _evaluated(seeking, nearest, tiles, n)
    radius = F.when(F.size("_top") == NEIGHBOURS, F.get("_top", F.lit(NEIGHBOURS - 1)).getField("s"))
    radii = (
        _tops(looked)
        .groupBy("_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("_m", radius.alias("r")))).alias("_at"))
    )
    reach = F.array(
        *[F.coalesce(F.try_element_at("_at", F.lit(i)), F.lit(float("inf"))) for i in range(n)]
    )
    within = cut_lineage(
        seeking.drop("_r").join(radii, "_id", "left").select(*by, "_tile", "_id", "_v", reach.alias("_r"))
    )
    opened = _looks(within, packs, n, by, "_r")
    return cut_lineage(_tops(_evaluated(within, opened, tiles, n)))


def _tops(found: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("s", "y")))
    return found.groupBy("_id", "_m").agg(F.slice(listed, 1, NEIGHBOURS).alias("_top"))


def _gathered(rows: DataFrame, by: list[str], content: Column, name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.collect_list(content).alias(name))


def _tiled(rows: DataFrame, n: int, by: list[str], tile_rows: int) -> DataFrame:
    """Add ``_tile``: a stretch of the panel's order by the halves of all months in turn.

    A missing month counts as lying between the nearest months that the row has.
    """
    value = [F.nanvl(F.get("_v", F.lit(i)), F.lit(None)) for i in range(n)]
    ranges = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.min(v).alias(f"_lo{i}") for i, v in enumerate(value)],
        *[F.max(v).alias(f"_hi{i}") for i, v in enumerate(value)],
    )
    spread = [F.col(f"_hi{i}") - F.col(f"_lo{i}") for i in range(n)]
    share = [
        F.when(spread[i] > 0, (value[i] - F.col(f"_lo{i}")) / spread[i]).otherwise(
            F.when(value[i].isNotNull(), 0.0)
        )
        for i in range(n)
    ]
    def filled(i: int) -> Column:
        """The level between those of the nearest months before and after."""
        before, after = F.coalesce(*share[i::-1], F.lit(None)), F.coalesce(*share[i:], F.lit(None))
        return (F.coalesce(before, after) + F.coalesce(after, before)) / 2

    steps = 1 << HALVINGS
    levels = [F.least(F.floor(filled(i) * steps), F.lit(steps - 1)) for i in range(n)]
    place = F.lit(0).cast("long")
    for bit in range(HALVINGS):
        for i in range(n):
            half = F.shiftright(F.col(f"_level{i}"), bit).bitwiseAND(F.lit(1).cast("long"))
            place = place.bitwiseOR(F.shiftleft(half, bit * n + i))
    ordered = (
        rows.join(ranges, by)
        .withColumns({f"_level{i}": level for i, level in enumerate(levels)})
        .withColumn("_place", place)
        .select(*rows.columns, "_rows", "_place")
    )
    numbered = with_row_index(ordered, [*by, "_place", "_id"], "_at")
    first = numbered.groupBy(*by).agg(F.min("_at").alias("_first"))
    size = F.greatest(F.lit(tile_rows), F.ceil(F.sqrt("_rows")))
    tile = F.col("_first") + F.floor((F.col("_at") - F.col("_first")) / size)
    return numbered.join(first, by).withColumn("_tile", tile.cast("long")).select(*rows.columns, "_tile")


def _packs(tiles: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Ranges, means, patterns and donors of the tiles of a panel, some tiles a row."""
    schema = T.StructType(
        [tiles.schema[c] for c in [*by, "_tile"]]
        + [
            T.StructField("_lo", T.ArrayType(T.DoubleType())),
            T.StructField("_hi", T.ArrayType(T.DoubleType())),
            T.StructField("_mean", T.ArrayType(T.DoubleType())),
            T.StructField("_masks", T.ArrayType(T.IntegerType())),
            T.StructField("_donors", T.ArrayType(T.LongType())),
        ]
    )
    bits = 1 << np.arange(n)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*by, "_tile"]].copy()
            lows, highs, means, masks, donors = [], [], [], [], []
            for flat, copies in zip(batch["_y"], batch["_copies"]):
                y = np.asarray(flat).reshape(-1, n)
                there = ~np.isnan(y)
                lows.append(np.where(there, y, np.inf).min(axis=0))
                highs.append(np.where(there, y, -np.inf).max(axis=0))
                total, many = np.where(there, y, 0.0).sum(axis=0), there.sum(axis=0)
                means.append(np.where(many > 0, total / np.maximum(many, 1), np.nan))
                masks.append(np.unique(there @ bits).astype(np.int32))
                donors.append(np.asarray(copies) @ there)
            out = out.assign(_lo=lows, _hi=highs, _mean=means, _masks=masks, _donors=donors)
            yield out[schema.names]

    described = cut_lineage(tiles.mapInPandas(describe, schema))
    sizes = described.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / PACK_TILES).alias("_many"))
    pack = F.pmod(F.xxhash64("_tile"), F.col("_many"))
    content = F.struct("_tile", "_lo", "_hi", "_mean", "_masks", "_donors")
    dealt = described.join(sizes, by).withColumn("_pack", pack)
    return _gathered(dealt, [*by, "_pack"], content, "_tiles").drop("_pack")


def least_distances(x: np.ndarray, low: np.ndarray, high: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """For each row of ``x`` a lower bound of its distance to every row of a tile; infinite where
    no row of the tile shares a month with it. ``masks`` are the tile's patterns."""
    n = x.shape[1]
    there = ~np.isnan(x)
    gap = np.maximum(np.maximum(low - x, x - high), 0.0)
    square = np.where(there & np.isfinite(low), gap, 0.0) ** 2
    patterns = ((masks[:, None] >> np.arange(n)) & 1).astype(float)
    common = there.astype(float) @ patterns.T
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(common > 0, n / common * (square @ patterns.T), np.inf)
    return bound.min(axis=1)


def _mean_distances(means: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(tile, row) distance to the tiles' means over the months that both have."""
    both = ~np.isnan(means)[:, None, :] & ~np.isnan(x)[None]
    square = np.where(both, means[:, None, :] - x[None], 0.0) ** 2
    return square.sum(axis=2) / np.maximum(both.sum(axis=2), 1)


def _looks(
    seeking: DataFrame, packs: DataFrame, n: int, by: list[str], radius: str | None
) -> DataFrame:
    """Without ``radius``: ``_id, _m, far, tile``, for each cell and pack the tile of the nearest mean,
    one with enough donors if there is any. With it: ``_id, tile`` for the tiles in which some
    missing month of the row has donors within the month's radius."""
    columns = ["_id", "_v", *([radius] if radius else [])]
    rows = _gathered(seeking, [*by, "_tile"], F.struct(*columns), "_seekers")
    schema = "_id bigint, tile bigint" if radius else "_id bigint, _m int, far double, tile bigint"

    def bounds_of(x: np.ndarray, tiles: list) -> np.ndarray:
        return np.stack(
            [
                least_distances(
                    x, np.asarray(t["_lo"]), np.asarray(t["_hi"]), np.asarray(t["_masks"])
                )
                for t in tiles
            ]
        )

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, flat, tiles, *reach in batch.itertuples(index=False):
                ids, x = np.asarray(ids), np.asarray(flat).reshape(-1, n)
                names = np.array([t["_tile"] for t in tiles])
                donors = np.stack([np.asarray(t["_donors"]) for t in tiles])
                bound = bounds_of(x, tiles)
                missing = np.isnan(x)
                if not reach:
                    means = np.stack([np.asarray(t["_mean"], dtype=float) for t in tiles])
                    mean_distance = _mean_distances(means, x)
                    for m in range(n):
                        wanting = np.flatnonzero(missing[:, m])
                        if not len(wanting) or not donors[:, m].any():
                            continue
                        own, near = mean_distance[:, wanting], np.isfinite(bound[:, wanting])
                        enough = (donors[:, m] >= NEIGHBOURS)[:, None] & near
                        any_donor = (donors[:, m] > 0)[:, None] & near
                        # Tiles with one donor come after all with enough.
                        rank = np.where(enough, own, np.where(any_donor, _LAST, np.inf))
                        at = rank.argmin(axis=0)
                        best = rank[at, np.arange(len(wanting))]
                        some = np.isfinite(best)
                        yield pd.DataFrame(
                            {
                                "_id": ids[wanting[some]],
                                "_m": np.int32(m),
                                "far": best[some],
                                "tile": names[at[some]],
                            }
                        )
                    continue
                limit = np.asarray(reach[0]).reshape(-1, n) * (1 + _SLACK)
                limit = np.where(missing, limit, -1.0)
                # The farthest radius among the row's missing months that the tile has.
                farthest = np.where((donors > 0)[:, None, :], limit[None], -1.0).max(axis=2)
                tile, row = np.nonzero((bound <= farthest) & np.isfinite(bound))
                yield pd.DataFrame({"_id": ids[row], "tile": names[tile]})

    beside = rows.join(packs, by).select(
        F.col("_seekers._id").alias("_ids"),
        F.flatten("_seekers._v").alias("_x"),
        "_tiles",
        *([F.flatten(f"_seekers.{radius}").alias("_reach")] if radius else []),
    )
    return cut_lineage(beside.mapInPandas(look, schema))


def _evaluated(seeking: DataFrame, opened: DataFrame, tiles: DataFrame, n: int) -> DataFrame:
    """Best donors of each row in each tile opened for it, as far as its radius: ``_id, _m, s, y``."""
    asked = opened.join(seeking.select("_id", "_v", "_r"), "_id")
    sizes = asked.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).alias("_many"))
    dealt = asked.join(sizes, "tile").withColumn("_pack", F.pmod(F.xxhash64("_id"), F.col("_many")))
    packs = _gathered(dealt, ["tile", "_pack"], F.struct("_id", "_v", "_r"), "_seekers")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, x, reach, y, copies in batch.itertuples(index=False):
                x, reach, y = (np.asarray(v).reshape(-1, n) for v in (x, reach, y))
                ids, copies = np.asarray(ids), np.asarray(copies)
                for rows, donors in within_reach(x, reach, y):
                    yield best_of_tile(ids[rows], x[rows], y[donors], copies[donors])

    meet = packs.join(tiles, packs["tile"] == tiles["_tile"]).select(
        F.col("_seekers._id").alias("_ids"),
        F.flatten("_seekers._v").alias("_x"),
        F.flatten("_seekers._r").alias("_reach"),
        "_y",
        "_copies",
    )
    return cut_lineage(meet.mapInPandas(search, _FOUND))


def within_reach(
    x: np.ndarray, reach: np.ndarray, y: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pattern by pattern of a tile: rows of ``x`` that it may matter to, and its rows in ``y``."""
    bits = 1 << np.arange(x.shape[1])
    patterns = ~np.isnan(y) @ bits
    wanting = np.where(np.isnan(x), reach * (1 + _SLACK), -1.0)
    for pattern in np.unique(patterns):
        donors = np.flatnonzero(patterns == pattern)
        has = (pattern & bits) > 0
        own = np.where(has, y[donors], 0.0)
        low, high = np.where(has, own.min(axis=0), np.inf), np.where(has, own.max(axis=0), -np.inf)
        bound = least_distances(x, low, high, np.array([pattern]))
        farthest = np.where(has, wanting, -1.0).max(axis=1)
        rows = np.flatnonzero((bound <= farthest) & np.isfinite(bound))
        if len(rows):
            yield rows, donors


def best_of_tile(ids: np.ndarray, x: np.ndarray, y: np.ndarray, copies: np.ndarray) -> pd.DataFrame:
    """Best two donors among ``y`` for each missing cell of ``x``."""
    n = x.shape[1]
    total = np.zeros((len(x), len(y)))
    common = np.zeros((len(x), len(y)))
    for t in range(n):
        diff = x[:, t, None] - y[None, :, t]
        both = ~np.isnan(diff)
        total += np.where(both, diff * diff, 0.0)
        common += both
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(common > 0, (n / common) * total, np.inf)
    found = []
    for m in range(n):
        wanting = np.flatnonzero(np.isnan(x[:, m]))
        holding = np.flatnonzero(~np.isnan(y[:, m]))
        # By value, so that equal distances go to the smaller one.
        holding = holding[np.argsort(y[holding, m], kind="stable")]
        holding = np.repeat(holding, copies[holding])
        if not len(wanting) or not len(holding):
            continue
        reach = scaled[np.ix_(wanting, holding)]
        for _ in range(NEIGHBOURS):
            at = reach.argmin(axis=1)
            s = reach[np.arange(len(wanting)), at]
            hit = np.isfinite(s)
            found.append((ids[wanting[hit]], np.full(hit.sum(), m), s[hit], y[holding[at[hit]], m]))
            reach[np.arange(len(wanting)), at] = np.inf
    columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], [], []]
    return pd.DataFrame(
        {
            "_id": np.asarray(columns[0], dtype=np.int64),
            "_m": np.asarray(columns[1], dtype=np.int32),
            "s": np.asarray(columns[2], dtype=float),
            "y": np.asarray(columns[3], dtype=float),
        }
    )


def _fill(vectors: DataFrame, tops: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Per vector with gaps: an array with a value at every gap."""
    cells = vectors.select(*keys, "_id", "_v", "_n", F.posexplode("_v").alias("_m", "_x"))
    means = (
        cells.filter(~F.isnan("_x"))
        .groupBy(*keys, "_m")
        .agg((F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    )
    near = F.aggregate("_top", F.lit(0.0), lambda a, c: a + c.getField("y")) / F.size("_top")
    value = F.coalesce(
        near,
        F.col("_mean"),
        F.raise_error(F.format_string("month column %d has no value", "_m")).cast("double"),
    )
    return (
        cells.filter(F.isnan("_x"))
        .select(*keys, "_id", "_v", "_m")
        .join(tops, ["_id", "_m"], "left")
        .join(means, [*keys, "_m"], "left")
        .groupBy(*keys, "_id", "_v")
        .agg(F.map_from_entries(F.collect_list(F.struct("_m", value))).alias("_at"))
        .select(
            *keys,
            "_v",
            F.array(*[F.try_element_at("_at", F.lit(i)) for i in range(n)]).alias("_fill"),
        )
    )
