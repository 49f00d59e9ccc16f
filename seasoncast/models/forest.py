"""One random forest for all later months of a season, for many panels and cutoffs at once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from typing_extensions import Self

from seasoncast.config import SeasonConfig
from seasoncast.functions.season import month_in_season, to_season
from seasoncast.models import trees
from seasoncast.operators.impute import knn_impute
from seasoncast.operators.prep import date_crosswalk, month_column
from seasoncast.operators.ranking import with_row_index
from seasoncast.operators.reshape import months_present, pivot_months
from seasoncast.schema import require_columns, require_no_nulls, require_rows
from seasoncast.sources.shared import cut_lineage, scratch_path

LAST_MONTH = 11


class Cutoff(NamedTuple):
    """Season and month index of a forecast date: all a forest knows of it."""

    season: str
    month: int


class ForestModel:
    """Forecasts the later months of the season from the months up to the forecast date.

    A forest has all later months as targets of each tree, and season, geography and the earlier
    months as features. Forests of all panels (``group_cols``) and forecast dates grow in one job;
    their nodes are a table. The months are filled from nearest neighbours first, over all rows of
    the panel, later ones included; ``impute_as_of`` in ``params`` hides cells after the forecast
    date from that step. Further ``params``: ``n_estimators`` (100), ``seed`` (0), ``max_depth``
    (none), ``bootstrap`` (true), and ``max_bins`` (1,024): splits are exact where a month of a
    panel has no more different values than that. A panel without a season before a cutoff, or
    without one from it on, has no forecasts for it; if that is so for all panels, it is an error.
    """

    def __init__(
        self,
        *,
        data: DataFrame,
        forecast_dates: Sequence[dt.date],
        params: dict[str, Any],
        season: SeasonConfig,
        quantiles: Sequence[float],
        group_cols: Sequence[str] = (),
        date_column: str = "time_end",
    ) -> None:
        require_columns(data, [*group_cols, date_column, "estimate", "season", "geography"])
        self.rows = month_column(data, season, date_column)
        self.forecast_dates = list(forecast_dates)
        self.params = dict(params)
        self.season = season
        self.quantiles = [float(q) for q in quantiles]
        self.group_cols = list(group_cols)
        self.date_column = date_column
        self.months = months_present(self.rows)
        #: Nodes of all trees, with their level; the number of a cutoff is its place in ``numbered``.
        self.nodes: DataFrame | None = None
        self._path: str | None = None
        self._tables: dict[dt.date | None, DataFrame] = {}
        self._indexed: dict[dt.date | None, DataFrame] = {}

    def cutoffs(self) -> dict[dt.date, Cutoff]:
        """Season and month of every forecast date."""
        spark = self.rows.sparkSession
        dates = spark.createDataFrame([(d,) for d in self.forecast_dates], "d date")
        labelled = dates.select(
            "d",
            to_season(F.col("d"), **self.season.bounds),
            month_in_season(F.col("d"), self.season.start_month),
        )
        out = {r[0]: Cutoff(r[1], r[2]) for r in labelled.collect()}
        outside = sorted(d for d, c in out.items() if c.season is None)
        if outside:
            raise AssertionError(f"forecast dates out of season: {outside}")
        return out

    def _as_of(self, forecast_date: dt.date) -> dt.date | None:
        return forecast_date if self.params.get("impute_as_of") else None

    def table(self, forecast_date: dt.date) -> DataFrame:
        """The complete month table; the same for all dates unless imputed as of the date."""
        as_of = self._as_of(forecast_date)
        if as_of not in self._tables:
            rows = self.rows
            if as_of is not None:
                known = F.col(self.date_column) <= F.lit(as_of)
                rows = rows.withColumn("estimate", F.when(known, F.col("estimate")))
            wide = pivot_months(rows, self.months, group_cols=self.group_cols)
            complete = cut_lineage(knn_impute(wide, self.months, self.group_cols))
            require_no_nulls(complete.drop(*self.group_cols))
            self._tables[as_of] = complete
        return self._tables[as_of]

    def _numbered_panels(self, table: DataFrame) -> DataFrame:
        """Add the group columns as ``_g0``, ``_g1`` and so on, and the panel's number ``_number``."""
        if not self.group_cols:
            return table.withColumn("_number", F.lit(0).cast("long"))
        panels = table.select(*self.group_cols).distinct()
        named = with_row_index(panels, self.group_cols, "_number").select(
            *[F.col(c).alias(f"_g{i}") for i, c in enumerate(self.group_cols)], "_number"
        )
        return table.join(named, self._same_panel())

    def _same_panel(self) -> Column:
        """Group columns equal to ``_g0``, ``_g1`` and so on, nulls included."""
        same = F.lit(True)
        for i, c in enumerate(self.group_cols):
            same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
        return same

    def features(self, forecast_date: dt.date) -> DataFrame:
        """The month table with ``panel``, ``idx`` (place in the panel, seasons in order), values
        and keys of the months; the group columns go as ``_g0``, ``_g1`` and so on."""
        as_of = self._as_of(forecast_date)
        if as_of not in self._indexed:
            named = self._numbered_panels(self.table(forecast_date)).select(
                F.col("_number").alias("panel"),
                *[f"_g{i}" for i in range(len(self.group_cols))],
                "season",
                "geography",
                *[F.col(str(m)).alias(trees.value_column(m)) for m in self.months],
            )
            ordered = with_row_index(named, ["panel", "season", "geography"], "idx")
            first = ordered.groupBy("panel").agg(F.min("idx").alias("_first"))
            placed = ordered.join(first, "panel").withColumn("idx", F.col("idx") - F.col("_first"))
            binned = trees.bin_keys(
                cut_lineage(placed.drop("_first")), self.months, int(self.params.get("max_bins", 1024))
            )
            self._indexed[as_of] = cut_lineage(binned)
        return self._indexed[as_of]

    def numbered(self) -> dict[Cutoff, list[dt.date]]:
        """Forecast dates of each cutoff with a later month, in order."""
        found: dict[Cutoff, list[dt.date]] = {}
        for date, cutoff in sorted(self.cutoffs().items()):
            if any(cutoff.month < m <= LAST_MONTH for m in self.months):
                found.setdefault(cutoff, []).append(date)
        return dict(sorted(found.items()))

    def _rows_of(self, past: bool) -> DataFrame | None:
        """Rows of all cutoffs: of the seasons before each, or of its own and later ones."""
        found = None
        for number, (cutoff, dates) in enumerate(self.numbered().items()):
            before = F.col("season") < F.lit(cutoff.season)
            own = require_rows(
                self.features(dates[0]).filter(before if past else ~before),
                f"no season before {cutoff.season} to train on"
                if past
                else f"no rows to forecast for {dates[0]}",
            )
            own = own.withColumns({"cutoff": F.lit(number), "last_given": F.lit(cutoff.month)})
            found = own if found is None else found.unionByName(own)
        return found

    def fit(self) -> Self:
        """Train on the seasons before the forecast season. Dates that share season and month share
        a forest."""
        rows = self._rows_of(past=True)
        if rows is None:
            self._path = ""
            return self
        sizes = rows.groupBy("panel", "cutoff").agg(F.count("*").alias("n"))
        samples = trees.draw_samples(
            rows.join(sizes, ["panel", "cutoff"]),
            int(self.params.get("n_estimators", 100)),
            int(self.params.get("seed", 0)),
            bool(self.params.get("bootstrap", True)),
        )
        spark = self.rows.sparkSession
        self._path = scratch_path(spark, "forest")
        depth = self.params.get("max_depth")
        trees.grow(samples, self.months, self._path, None if depth is None else int(depth))
        self.nodes = spark.read.parquet(self._path)
        return self

    def predict(self) -> DataFrame:
        """Quantiles over trees for the months after each forecast date."""
        if self._path is None:
            raise AssertionError("fit the model first")
        spark = self.rows.sparkSession
        panel = [f"_g{i}" for i in range(len(self.group_cols))]
        key = ["cutoff", *panel, "season", "geography"]
        rows = self._rows_of(past=False)
        if rows is None:
            kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema.fields}
            groups = "".join(f"`{c}` {kinds[c]}, " for c in self.group_cols)
            return spark.createDataFrame(
                [],
                f"{groups}forecast_date date, season string, geography {kinds['geography']}, "
                f"quantile double, {self.date_column} date, estimate double",
            )
        values = [trees.value_column(m) for m in self.months]
        grown = self.nodes.filter("path = ''").select(*trees.UNIT)
        of_tree = rows.join(grown, ["panel", "cutoff"])
        leaves = trees.reached(
            of_tree.select(*trees.UNIT, "last_given", *key[1:], *values), self.nodes, self.months
        )
        quantiles = F.array(*[F.lit(q) for q in self.quantiles])
        later = [(i, m) for i, m in enumerate(self.months) if m <= LAST_MONTH]
        across = leaves.groupBy(*key, "last_given").agg(
            *[F.percentile(F.get("means", F.lit(i)), quantiles).alias(f"e{m}") for i, m in later]
        )
        by_month = F.array(
            *[
                F.struct(
                    F.lit(m).cast("long").alias("t"),
                    F.arrays_zip(
                        quantiles.alias("quantile"), F.col(f"e{m}").alias("estimate")
                    ).alias("q"),
                )
                for _, m in later
            ]
        )
        long = (
            across.select(*key, "last_given", F.explode(by_month).alias("m"))
            .filter("m.t > last_given")
            .select(*key, "m.t", F.explode("m.q").alias("q"))
            .select(*key, "t", "q.quantile", "q.estimate")
        )
        dates = spark.createDataFrame(
            [(i, d) for i, own in enumerate(self.numbered().values()) for d in own],
            "cutoff int, forecast_date date",
        )
        return self._dated(long.join(dates, "cutoff"))

    def _dated(self, long: DataFrame) -> DataFrame:
        """Attach dates: null where a season has no row for the month."""
        dates = date_crosswalk(self.rows, self.date_column, self.group_cols).withColumnsRenamed(
            {"season": "_season", "t": "_t"}
        )
        same = (F.col("season") == F.col("_season")) & (F.col("t") == F.col("_t"))
        return long.join(dates, same & self._same_panel(), "left").select(
            *[F.col(f"_g{i}").alias(c) for i, c in enumerate(self.group_cols)],
            "forecast_date",
            "season",
            "geography",
            "quantile",
            self.date_column,
            "estimate",
        )

    def save(self, path: str) -> None:
        """Write the nodes, all that a fitted model consists of."""
        if self.nodes is None:
            raise AssertionError("nothing to save: fit the model first")
        self.nodes.write.mode("overwrite").partitionBy("level").parquet(f"{path}/nodes")

    def load(self, spark: SparkSession, path: str) -> Self:
        self._path = f"{path}/nodes"
        self.nodes = spark.read.parquet(self._path)
        return self
